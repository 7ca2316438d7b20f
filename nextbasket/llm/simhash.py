"""SimHash near-duplicates: all pairs of fingerprints within a distance, by the generalised pigeonhole principle.

1. A fingerprint is the majority of the bits of a document's shingle hashes; equal fingerprints are one node.
2. Bits that go together are grouped into partitions, by their correlation over all nodes. If thresholds t_i of the partitions
   have sum(t_i + 1) = distance + 1, two fingerprints within the distance agree up to t_i bits in some partition i.
3. Each node chooses its own thresholds: dynamic programming over the partitions minimises probes and candidates, which are
   estimated from counts of all nodes by their bits in each partition. A partition where the node's bits are common gets -1, which is no probe.
4. A node probes its partitions with all values that its thresholds allow; what has such a value is verified by the whole distance.
5. Nodes of one component need no link: where a partition value has very many nodes, these are first compared with a hub near
   their middle, and later only pairs of different components are kept. Components by large and small stars.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .jaccard import components, edges

BITS = 64
SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Bits of a partition by which nodes are counted: a table of 2**16 cells for each partition.
CELL = 16
#: A probe travels; a candidate only meets it. So many candidates cost as much as a probe.
PROBE_COST = 16.0


def shingle_hashes(text: bytes, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, some thousands at a time; fewer words are one shingle."""
    carry: list[bytes] = []
    at, some = 0, False
    while at < len(text):
        m = SEPARATOR.search(text, min(len(text), at + PIECE))
        end = m.start() if m else len(text)
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) >= width:
            joined = b" ".join(words)
            ends = list(itertools.accumulate(len(w) + 1 for w in words))
            begins = [0, *ends]
            hashed = xxhash.xxh64_intdigest
            yield np.array([hashed(joined[a : b - 1], seed) for a, b in zip(begins, ends[width - 1 :], strict=False)], np.uint64)
            some = True
        carry = words[-(width - 1) :] if width > 1 else []
    if not some and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], np.uint64)


def unpacked(h: np.ndarray) -> np.ndarray:
    """A row of BITS bits for each value, the lowest first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Bits that are set in over half the hashes; 0 without words."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for h in shingle_hashes(text, width, seed):
        n += len(h)
        for k in range(0, len(h), 1 << 14):
            ones += unpacked(h[k : k + (1 << 14)]).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (64 bits as a signed number) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint((t or "").encode(), width, seed) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many nodes there are, and for each two bits how many have both: one table of BITS * BITS sums from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            x = unpacked(b["fp"].to_numpy().view(np.uint64)).astype(np.float32)  # a batch has fewer rows than float32 counts exactly
            n += len(x)
            both += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS)), pa.array(np.append(n, both.ravel()))], ["at", "n"])

    out = np.zeros(BITS * BITS + 1, np.int64)
    for at, n in nodes.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # 4,097 rows at most
        out[at + 1] = n
    return int(out[0]), out[1:].reshape(BITS, BITS)


def partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` groups of nearly equal size, correlated ones together: each group grows by the bit that goes most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    fixed = spread == 0  # bits that are the same in all nodes tell nothing: they go together
    c[fixed[:, None] != fixed[None]] = 0
    c[fixed[:, None] & fixed[None]] = 1
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS * (k + 1)) // parts - (BITS * k) // parts
        near = c[np.ix_(left, left)] - 2 * np.eye(len(left))
        group = [left[int(np.argmax(near.max(1)))]] if len(left) > 1 else list(left)
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (c[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def cells(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The first CELL of these bits as one number."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits[:CELL]):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def cell_counts(nodes: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For each group of bits the nodes by cell: an array of fixed size from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), 1 << CELL), np.int64)
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for k, bits in enumerate(groups):
                total[k] += np.bincount(cells(fp, bits), minlength=1 << CELL)
        some = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], ["cell", "n"])

    got = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most for each group
    out = np.zeros(len(groups) << CELL, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return list(out.reshape(len(groups), -1))


def expected(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """[s, cell]: candidates of a node in this cell with threshold s - 1, for s up to most + 1. Exact for CELL bits; further bits count as even and independent."""
    at = np.arange(len(counts))
    shell = np.zeros((most + 1, len(counts)))
    shell[0] = counts
    for k in range(min(width, CELL)):
        wider = shell.copy()
        wider[1:] += shell[:-1][:, at ^ (1 << k)]
        shell = wider
    for _ in range(width - CELL):
        half = shell / 2
        half[1:] += shell[:-1] / 2
        shell = half
    return np.concatenate([np.zeros((1, len(counts))), np.cumsum(shell, 0)]).astype(np.float32)


def thresholds(fp: np.ndarray, groups: list[list[int]], tables: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """[node, partition]: the thresholds, from -1, of least cost with sum(t + 1) = most + 1, by dynamic programming over the partitions; and the costs."""
    budget = most + 1
    best = np.full((budget + 1, len(fp)), np.inf)
    best[0] = 0
    chosen = []
    for bits, expect in zip(groups, tables, strict=True):
        cell = cells(fp, bits)
        probes = np.cumsum([0] + [math.comb(len(bits), t) for t in range(budget)])
        cost = PROBE_COST * probes[:, None] + expect[:, cell]
        options = np.full((budget + 1, budget + 1, len(fp)), np.inf)  # [spent so far and here, here]
        for s in range(budget + 1):
            options[s:, s] = best[: budget + 1 - s] + cost[s]
        chosen.append(options.argmin(1))
        best = options.min(1)
    out, left = np.empty((len(fp), len(groups)), np.int64), np.full(len(fp), budget)
    for k in range(len(groups) - 1, -1, -1):
        here = chosen[k][left, np.arange(len(fp))]
        out[:, k], left = here - 1, left - here
    return out, best[budget]


def flips(bits: list[int], most: int) -> np.ndarray:
    """Masks of up to `most` of the bits."""
    return np.array([sum(1 << b for b in c) for t in range(most + 1) for c in itertools.combinations(bits, t)], np.uint64)


def mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


class Join:
    """distance: that links. parts: numbers of partitions among which the estimates choose. hot: nodes of one partition value from which they are compared with a hub first; rounds: of that, at most.

    None of the others changes a result.
    """

    def __init__(self, distance: int = 4, width: int = 4, seed: int = 42, parts: tuple[int, ...] = (5, 4, 3, 2), hot: int = 64, rounds: int = 4):
        self.distance, self.width, self.seed, self.parts, self.hot, self.rounds = distance, width, seed, parts, hot, rounds

    def plan(self, nodes: DataFrame) -> tuple[list[list[int]], list[np.ndarray]]:
        """The partitions and their tables of expected candidates, of the number of partitions that a few thousand nodes find cheapest."""
        n, both = together(nodes)
        ways = [partitions(n, both, k) for k in self.parts]
        counts = iter(cell_counts(nodes, [g for way in ways for g in way]))
        some = nodes.select("fp").limit(4096).toArrow()["fp"].to_numpy().view(np.uint64)
        found = []
        for way in ways:
            tables = [expected(next(counts), len(g), self.distance) for g in way]
            found.append((thresholds(some, way, tables, self.distance)[1].sum(), len(way), way, tables))
        _, _, way, tables = min(found, key=lambda x: x[:2])
        return way, tables

    def values(self, nodes: DataFrame, groups: list[list[int]]) -> DataFrame:
        """part, value and the node's columns: a row for each node and partition."""
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask(g))).alias("value")) for k, g in enumerate(groups))))
        return nodes.select(each.alias("at"), *nodes.columns).select("at.part", "at.value", *nodes.columns)

    def probes(self, nodes: DataFrame, groups: list[list[int]], tables: list[np.ndarray]) -> DataFrame:
        """part, value, fp, label, members: all values that each node has to look for."""
        most = self.distance
        held = nodes.sparkSession.sparkContext.broadcast(tables)  # parts * (distance + 2) * 2**16 floats

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, around = held.value, {}
            for b in batches:
                for k in range(0, b.num_rows, 1024):
                    part = b.slice(k, 1024)
                    fp, label, members = (part[c].to_numpy() for c in ("fp", "label", "members"))
                    t, _ = thresholds(fp.view(np.uint64), groups, tables, most)
                    for i, bits in enumerate(groups):
                        for radius in np.unique(t[:, i]).tolist():
                            if radius < 0:
                                continue
                            if (i, radius) not in around:
                                around[i, radius] = flips(bits, radius)
                            use, near = np.flatnonzero(t[:, i] == radius), around[i, radius]
                            value = ((fp[use] & mask(bits)).view(np.uint64)[:, None] ^ near[None]).ravel().view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)), pa.array(value), *(pa.array(np.repeat(x[use], len(near))) for x in (fp, label, members))], ["part", "value", "fp", "label", "members"])

        return nodes.select("fp", "label", "members").mapInArrow(run, "part int, value long, fp long, label long, members long")

    def hub_links(self, nodes: DataFrame, groups: list[list[int]]) -> DataFrame | None:
        """fp, label, of nodes that some hub joins to others: in each round all nodes of a partition value that has many left are compared with the one of them nearest to their middle."""
        found = None
        left = saved(self.values(nodes, groups))
        total = left.count()
        near = lambda x: F.bit_count(F.col("fp").bitwiseXOR(F.col(x)))
        for _ in range(self.rounds):
            sizes = saved(left.groupBy("part", "value").agg(F.count("*").alias("size")).where(F.col("size") > self.hot))
            if not sizes.limit(1).count():
                break
            members = saved(by_size(left, sizes, ["part", "value"], total))
            ones = [F.sum(F.shiftright("fp", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(BITS)]
            middle = sum((F.when(F.col(f"b{k}") * 2 > F.col("size"), F.lit(mask([k]))).otherwise(0) for k in range(1, BITS)), F.when(F.col("b0") * 2 > F.col("size"), 1).otherwise(0))
            middles = members.groupBy("part", "value", "size").agg(*ones).select("part", "value", "size", middle.cast("long").alias("middle"))
            hubs = by_size(members.drop("size"), middles, ["part", "value"], total).groupBy("part", "value", "size").agg(F.min_by("fp", F.struct(near("middle"), "fp")).alias("hub"))
            compared = saved(by_size(members.drop("size"), saved(hubs), ["part", "value"], total).withColumn("linked", near("hub") <= self.distance))
            new = edges(compared.where("linked and fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())
            found = saved(new) if found is None else saved(found.unionByName(new))
            left = compared.where("not linked").select("part", "value", "fp")
        return None if found is None or not found.limit(1).count() else components(found)

    def run(self, docs: DataFrame) -> DataFrame:
        prints = saved(fingerprints(docs, self.width, self.seed))
        nodes = saved(prints.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")))
        groups, tables = self.plan(nodes)
        joined = self.hub_links(nodes.select("fp"), groups)
        known = nodes.select("fp", F.col("fp").alias("label"), F.lit(1).cast("long").alias("members"))
        if joined is not None:
            labels = joined.withColumnRenamed("id", "fp")
            sizes = labels.groupBy("label").agg((F.count("*") + 1).alias("members"))
            labels = by_size(labels, sizes, ["label"], labels.count()).unionByName(sizes.select(F.col("label").alias("fp"), "members", "label").select("label", "fp", "members"))
            known = nodes.select("fp").join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("members", F.lit(1).cast("long")).alias("members"))
        known = saved(known)
        # of two components, nodes of the smaller one look for those of the other
        q, d = self.probes(known, groups, tables).alias("q"), self.values(known, groups).alias("d")
        smaller = (F.col("q.members") < F.col("d.members")) | (F.col("q.members") == F.col("d.members")) & (F.col("q.label") < F.col("d.label"))
        verified = F.bit_count(F.col("q.fp").bitwiseXOR(F.col("d.fp"))) <= self.distance
        links = saved(q.join(d, (F.col("q.part") == F.col("d.part")) & (F.col("q.value") == F.col("d.value")) & smaller & verified).select(F.col("q.label").alias("a"), F.col("d.label").alias("b")).distinct())
        labels = components(edges(links)) if links.limit(1).count() else None
        known = known.select("fp", "label")
        if labels is not None:
            known = known.join(labels.select(F.col("id").alias("label"), F.col("label").alias("last")), "label", "left").select("fp", F.coalesce("last", "label").alias("label"))
        least = nodes.join(known, "fp").groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("_n"))
        component = by_size(known, least.withColumnRenamed("_n", "size"), ["label"], nodes.count()).select("fp", "component_id")
        sized = saved(component.join(nodes.select("fp", F.col("copies").alias("size")), "fp"))
        out = by_size(prints, sized, ["fp"], prints.count())
        return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def by_size(rows: DataFrame, side: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with side, which has one row for each key and how many of the `total` rows have it (size, members), or nothing for rows to drop.

    Keys of more than a 1,024th of the rows are at most 1,024, so these go to all tasks; no other key is large for a task.
    """
    size = F.col("size" if "size" in side.columns else "members")
    large = F.broadcast(side.where(size * 1024 > total))
    rest = rows.join(large.select(*keys), keys, "left_anti").join(side.where(size * 1024 <= total), keys)
    return rows.join(large, keys).unionByName(rest)


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs(doc_id, text, ...): the smallest doc_id that is reachable over pairs within the distance.

    Words are runs without ASCII white space, A-Z lower-cased; fewer than width of them are one shingle. Nulls: a null text is empty; texts without words have the
    fingerprint zero and link like others; a row with a null doc_id takes part, and gets null only where its whole component has none. Rows that repeat a doc_id are
    documents of their own. Texts of any length are whole. An empty table gives no rows, other columns are dropped.
    """
    return Join(**settings).run(docs)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document, at a distance of 4 bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))

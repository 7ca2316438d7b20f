"""N-gram Jaccard join: all links of word-shingle sets, found by signature trees inside groups that share a prefix shingle.

1. A document's set is that of its hashed 5-word shingles; equal sets are one node, known by a 64-bit digest.
2. Prefix filter: two sets can only link if they share a shingle among the first n - ceil(t*n) + 1 of each, in any order that
   is the same for all. The order puts very frequent shingles last, so that shared passages do not bring documents together.
   Shingles with many nodes are dealt to several tasks by a salt wherever rows meet by shingle, and so are their hubs.
3. Every node of a group is first compared with the group's smallest node, then, in groups of several components, with the node
   that shares the most prefix shingles with others. What links is joined to one component.
4. Groups whose other nodes still lie in several components become signature trees: leaves of bounded size, grouped by size range and component.
   A node holds the OR of its sets' bitmaps, its size range and its component range. Leaf pairs are pruned by size range,
   by maximum possible overlap and where both sides lie in one component; dual traversal goes on inside each leaf pair.
   What is left is compared exactly; only links that join two components leave a task.
5. Connected components of all links by alternating large and small stars.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitset, frequent, in_bitset, saved, shingles, slices, table, words

WORDS64 = 32  # the bitmap of a tree's node has 2,048 bits; that of a large set is a multiple, and folds to it
FAN = 8


def needed(n, m, percent: int):
    """The smallest overlap that links sets of n and m shingles: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Of a power of two bits, two or more for each shingle, up to 2**18."""
    size = max(64 * WORDS64, min(1 << 18, 1 << (2 * len(s) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[s & np.uint64(size - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def folded(bits: np.ndarray, words: int = WORDS64) -> np.ndarray:
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words))


def may_link(a: np.ndarray, b: np.ndarray, n: int, m: int, percent: int) -> bool:
    """By what each bitmap has alone, at the narrower one's width."""
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return most >= needed(n, m, percent)


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def tree(bits: np.ndarray, n: np.ndarray, comp: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from the leaves, which are single sets in order of size, to the root: OR bitmap, size range, most collisions, component range."""
    spare = n - np.bitwise_count(bits).sum(1).astype(np.int64)
    levels = [(bits, n, n, spare, comp, comp)]
    while len(levels[-1][0]) > 1:
        b, lo, hi, c, first, last = levels[-1]
        at = np.arange(0, len(b), FAN)
        levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(c, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
    return levels


def dual_traversal(wide: list[np.ndarray], n: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j (places in the arrays, which are sorted by n) of different components whose maximum possible overlap allows a link."""
    bits = np.stack([folded(b) for b in wide])
    if len(n) <= FAN:  # one node of the tree: its sets face each other
        levels, (i, j) = [(bits, n, n, n, comp, comp)], np.triu_indices(len(n), 1)
    else:
        levels = tree(bits, n, comp)
        i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        b, lo, hi, spare, first, last = levels[depth]
        ok = (hi[i] * 100 >= lo[j] * percent) & ((first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j]))
        if depth == 0:
            ok &= i < j
        i, j = i[ok], j[ok]
        keep = []
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            if depth:  # no set of one side can share more than the bits that both sides have, and collisions on top
                most = np.bitwise_count(b[x] & b[y]).sum(1).astype(np.int64) + np.minimum(spare[x], spare[y])
                keep.append((most >= needed(lo[x], lo[y], percent)) | (x == y))
            else:
                alone_x, alone_y = np.bitwise_count(b[x] & ~b[y]).sum(1).astype(np.int64), np.bitwise_count(b[y] & ~b[x]).sum(1).astype(np.int64)
                keep.append(np.minimum(n[x] - alone_x, n[y] - alone_y) >= needed(n[x], n[y], percent))
        ok = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        if not depth:
            fine = np.array([len(wide[x]) == WORDS64 or may_link(wide[x], wide[y], int(n[x]), int(n[y]), percent) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
            return i[fine], j[fine]
        below = len(levels[depth - 1][0])
        i, j = (np.repeat(i, FAN * FAN) * FAN + np.tile(np.repeat(np.arange(FAN), FAN), len(i)), np.repeat(j, FAN * FAN) * FAN + np.tile(np.arange(FAN), len(j) * FAN))
        ok = (i < below) & (j < below) & (i <= j)
        i, j = i[ok], j[ok]
    return i, j


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["id"], pa.array([folded(np.frombuffer(x, np.uint64)).tobytes() for x in b["bits"].to_pylist()], pa.binary())], ["id", "bits"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(a) else 0


def spanning_links(sets: list[np.ndarray], comp: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Those of the pairs that link and join two components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(int(comp[x])), root(int(comp[y]))
        if a != b and overlap(sets[x], sets[y]) >= needed(len(sets[x]), len(sets[y]), percent):
            parent[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def star_step(e: DataFrame) -> DataFrame:
    """One large and one small star on the edges e(u > v): the same components, with edges nearer to each one's smallest id."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    pairs = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
    return saved(pairs.select("p.u", "p.v").where("u != v").distinct())


def edges(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")


def labels_of(e: DataFrame) -> DataFrame:
    """id, label: a smaller id of the same component; ids without one are left out."""
    return e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")


def components(e: DataFrame) -> DataFrame:
    """id, label (the smallest id of its component) for all other ids of the edges e(u > v)."""
    while True:
        e = star_step(e)
        # done where every u has one v, and no v is a u
        ends = e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 or up = 1 and down = 1").limit(1).count():
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))


class Join:
    """The join's settings. leaf: sets in a leaf. rounds: of comparisons with hubs. frequent: uses from which a shingle goes last, most_frequent: the most such shingles (8 bytes each
    to every task; any choice of them gives the same links). filter_bits: the size of the bitmap that spares unneeded sets the shuffle.
    hot: rows of a shingle from which they are dealt to several tasks; a 1,024th of all rows where that is more, so there are at most 1,024 such shingles."""

    def __init__(self, percent: int = 80, width: int = 5, leaf: int = 512, frequent: int = 32, rounds: int = 1, most_frequent: int = 1 << 17, filter_bits: int = 1 << 23, hot: int = 64):
        self.percent, self.width, self.leaf, self.rounds = percent, width, leaf, rounds
        self.frequent, self.most_frequent, self.filter_bits, self.hot = frequent, most_frequent, filter_bits, hot

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def frequent_shingles(self, docs: DataFrame) -> np.ndarray:
        """Prefix shingles that tasks meet more than `frequent` times; a shingle that a task sees once is not counted there."""
        width, prefix = self.width, self.prefix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def flush() -> Iterator[pa.RecordBatch]:
                key, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

            for b in batches:
                for _, _, data, at in slices(b["text"]):
                    held += [s[: prefix(len(s))] for s in shingles(*words(data, at), width) if len(s)]
                    if sum(map(len, held)) > 1 << 21:
                        yield from flush()
            if held:
                yield from flush()

        counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        top = frequent(saved(counts.where(F.col("n") > self.frequent)), "n", self.most_frequent).toArrow()
        return np.sort(top["h"].to_numpy().view(np.uint64))

    def sets(self, docs: DataFrame) -> DataFrame:
        """doc_id, id (null for an empty set), n, prefix, bits for each row."""
        frequent, width, prefix = docs.sparkSession.sparkContext.broadcast(self.frequent_shingles(docs)), self.width, self.prefix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = frequent.value
            for b in batches:
                for i, j, data, at in slices(b["text"]):
                    ids, sizes, heads, bits = [], [], [], []
                    for s in shingles(*words(data, at), width):
                        sizes.append(len(s))
                        ids.append(digest(s) if len(s) else None)
                        bits.append(bitmap(s).tobytes() if len(s) else None)
                        p = prefix(len(s)) if len(s) else 0
                        if len(last) and p:
                            late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                            if late[:p].any():
                                s = np.concatenate([s[~late], s[late]])
                        heads.append(s[:p].view(np.int64))
                    heads_at = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(heads_at, np.concatenate(heads)), pa.array(bits, pa.binary())], ["doc_id", "id", "n", "prefix", "bits"])

        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, id long, n long, prefix array<long>, bits binary")

    def full_sets(self, docs: DataFrame, ids: DataFrame) -> DataFrame:
        """id, shingles (8 bytes each) of the wanted ids; a bitmap of fixed size keeps nearly all others from the shuffle."""
        ids = saved(ids)
        if not ids.limit(1).count():  # no pass over the texts for nothing
            return ids.select("id", F.lit(None).cast("binary").alias("shingles"))
        width, shared = self.width, docs.sparkSession.sparkContext.broadcast(bitset(ids, "id", self.filter_bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = shared.value
            for b in batches:
                for _, _, data, at in slices(b["text"]):
                    found = []
                    for s in shingles(*words(data, at), width):
                        if len(s):
                            i = digest(s)
                            if in_bitset(wanted, np.array([i])).any():
                                found.append((i, s.tobytes()))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([x for _, x in found], pa.binary())], ["id", "shingles"])

        return docs.select("text").mapInArrow(run, "id long, shingles binary").join(ids, "id", "left_semi").dropDuplicates(["id"])

    def star_links(self, docs: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """Links between a group's smallest node and its others."""
        percent = self.percent

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                rows = zip(*(t[c].to_pylist() for c in ("a_bits", "b_bits", "a_n", "b_n")), strict=True)
                keep = [may_link(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m, percent) for x, y, n, m in rows]
                yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                x, y = ([np.frombuffer(s, np.uint64) for s in t[c].to_pylist()] for c in ("a_set", "b_set"))
                yield t.select(["a", "b"]).filter(pa.array([overlap(p, q) >= needed(len(p), len(q), percent) for p, q in zip(x, y, strict=True)], pa.bool_()))

        fit = F.least("n", "low_n") * 100 >= F.greatest("n", "low_n") * percent
        # the hubs of hot shingles, 1,024 at most
        hubs = F.broadcast(members.where(F.col("size") > self.hot).groupBy(F.col("low").alias("a")).agg(F.ceil(F.max("size") / self.hot).cast("int").alias("parts")))

        def dealt(pairs: DataFrame) -> DataFrame:
            return pairs.join(hubs, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

        def copied(hub: DataFrame) -> DataFrame:
            return hub.join(hubs, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

        sized = dealt(members.where("id != low").where(fit).select(F.col("low").alias("a"), F.col("id").alias("b")).distinct())
        side = lambda c, *more: nodes.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in more))
        open_ = saved(sized.join(side("b", "n", "bits"), "b").join(copied(side("a", "n", "bits")), ["a", "salt"]).mapInArrow(possible, "a long, b long"))
        full = saved(self.full_sets(docs, open_.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        side = lambda c: full.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set"))
        return dealt(open_).join(copied(side("a")), ["a", "salt"]).join(side("b"), "b").mapInArrow(exact, "a long, b long")

    def by_group(self, rows: DataFrame, groups: DataFrame, keys: tuple[str, ...] = ("h",)) -> DataFrame:
        """rows(size, id, keys) with the columns of groups(size, keys): hot groups are dealt by a hash of id. size: the rows of the shingle."""
        parts = F.when(F.col("size") > self.hot, F.ceil(F.col("size") / self.hot)).otherwise(1).cast("int")
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size")
        return rows.withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int")).join(salted, [*keys, "salt"]).drop("salt")

    def hubs(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """members of groups of several components; low is now the node with the most partners over all such groups."""
        mixed = saved(self.mixed(members, labels))
        partners = mixed.groupBy("id").agg(F.sum("left").alias("partners"))
        low = mixed.join(partners, "id").groupBy("h", "size").agg(F.max(F.struct("partners", "id", "n")).alias("top")).select("h", "size", F.col("top.id").alias("low"), F.col("top.n").alias("low_n"))
        return saved(self.by_group(mixed.select("h", "id", "n", "size"), low))

    def mixed(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """h, id, n, size, comp, left: the members of groups that hold several components; left: how many there are in the group."""
        known = members.join(labels, "id", "left").select("h", "id", "n", "size", F.coalesce("label", "id").alias("comp"))
        groups = known.groupBy("h", "size").agg(F.count("*").alias("left"), F.min("comp").alias("first"), F.max("comp").alias("last")).where("first != last").select("h", "size", "left")
        return self.by_group(known, groups)

    def leaves(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """h, leaf, id, n, comp: the members of groups that hold several components, dealt to leaves."""
        mixed = saved(self.mixed(members, labels))
        small = mixed.where(F.col("left") <= self.leaf).select("h", F.col("h").alias("leaf"), "id", "n", "comp")
        if not mixed.where(F.col("left") > self.leaf).limit(1).count():
            return small
        band = F.floor(F.log("n") / np.log(100 / self.percent)).cast("int")
        large = mixed.where(F.col("left") > self.leaf).select("h", "id", "n", "size", "comp", band.alias("band"))
        parts = lambda keys, name: large.groupBy(*keys, "size").agg(F.ceil(F.count("*") / self.leaf).alias(name))
        large = self.by_group(large, parts(["h", "band"], "parts"), ("h", "band")).withColumn("part", F.pmod(F.xxhash64("comp"), "parts"))
        large = self.by_group(large, parts(["h", "band", "part"], "pieces"), ("h", "band", "part")).withColumn("piece", F.pmod(F.xxhash64("id", F.lit(1)), "pieces"))
        return small.union(large.select("h", F.xxhash64("h", "band", "part", "piece").alias("leaf"), "id", "n", "comp"))

    def leaf_pairs(self, leaves: DataFrame, nodes: DataFrame, known: list) -> DataFrame:
        """h, l, r: the pairs of leaves of large groups whose OR bitmaps and sizes allow a link between two components."""
        percent = self.percent
        word = lambda k: F.conv(F.hex(F.substring("bits", 8 * k + 1, 8)), 16, -10).cast("long")
        fold = nodes.mapInArrow(fold_batches, "id long, bits binary")
        wide = leaves.where(F.col("leaf") != F.col("h")).join(fold.select("id", *(word(k).alias(f"w{k}") for k in range(WORDS64))), "id")
        spare = F.col("n") - sum((F.bit_count(f"w{k}") for k in range(1, WORDS64)), F.bit_count("w0"))
        ors = [F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS64)]
        large = saved(wide.groupBy("h", "leaf").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(spare).alias("spare"), *known[1:3], *ors))
        # the pairs of a group's leaves are dealt to as many tasks as keep a few leaves against all in each
        parts = large.groupBy("h").agg(F.ceil(F.count("*") / 8).cast("int").alias("parts"))
        x = large.join(parts, "h").withColumn("salt", F.pmod(F.xxhash64("leaf"), "parts").cast("int")).alias("x")
        y = large.join(parts, "h").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
        most = sum((F.bit_count(F.col(f"x.w{k}").bitwiseAND(F.col(f"y.w{k}"))) for k in range(1, WORDS64)), F.bit_count(F.col("x.w0").bitwiseAND(F.col("y.w0")))) + F.least("x.spare", "y.spare")
        least = F.ceil((F.col("x.lo") + F.col("y.lo")) * percent / (100 + percent))
        apart = (F.col("x.first") != F.col("x.last")) | (F.col("y.first") != F.col("y.last")) | (F.col("x.first") != F.col("y.first"))
        near = (F.col("x.hi") * 100 >= F.col("y.lo") * percent) & (F.col("y.hi") * 100 >= F.col("x.lo") * percent)
        return x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.leaf") < F.col("y.leaf")) & near & apart & (most >= least)).select("x.h", F.col("x.leaf").alias("l"), F.col("y.leaf").alias("r"))

    def tree_links(self, docs: DataFrame, members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        percent = self.percent
        leaves = saved(self.leaves(members, labels))
        # leaves of the same sets need one look
        known = [F.count("*").alias("size"), F.min("comp").alias("first"), F.max("comp").alias("last"), *(F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2))]
        alone = leaves.groupBy("h", "leaf").agg(*known).where("first != last").groupBy("size", "x1", "x2").agg(F.min("leaf").alias("l"), F.min_by("h", "leaf").alias("h")).select("h", "l", F.col("l").alias("r"))
        pairs = alone
        if leaves.where("leaf != h").limit(1).count():
            pairs = alone.union(self.leaf_pairs(leaves, nodes, known))
        pairs = pairs.withColumn("pair", F.xxhash64("h", "l", "r"))
        looks = pairs.select("h", "pair", F.explode(F.array_distinct(F.array("l", "r"))).alias("leaf")).join(leaves, ["h", "leaf"]).select("pair", "id", "n", "comp")

        def arrays(t: pa.RecordBatch, k: int, name: str) -> tuple[np.ndarray, ...]:
            x = t["m"][k].values
            order = np.argsort(x.field("n").to_numpy(), kind="stable")
            raw = x.field(name).to_pylist()
            return order, *(x.field(c).to_numpy()[order] for c in ("n", "comp", "id")), [raw[o] for o in order.tolist()]

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                pair, ids, comps = [], [], []
                for k in range(t.num_rows):
                    _, n, comp, node, raw = arrays(t, k, "bits")
                    i, j = dual_traversal([np.frombuffer(x, np.uint64) for x in raw], n, comp, percent)
                    use = np.unique(np.concatenate([i, j]))
                    pair.append(np.full(len(use), t["pair"][k].as_py()))
                    ids.append(node[use])
                    comps.append(comp[use])
                if pair:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (pair, ids, comps)], ["pair", "id", "comp"])

        members_of = lambda df, *c: df.groupBy("pair").agg(F.collect_list(F.struct("id", "n", "comp", *c)).alias("m"))  # noqa: E731  of two leaves at most
        open_ = saved(members_of(looks.join(nodes.select("id", "bits"), "id"), "bits").mapInArrow(possible, "pair long, id long, comp long"))
        same = open_.groupBy("pair").agg(F.count("*").alias("size"), *known[3:]).groupBy("size", "x1", "x2").agg(F.min("pair").alias("pair"))
        open_ = open_.join(same.select("pair"), "pair", "left_semi")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                out: list[tuple[int, int]] = []
                for k in range(t.num_rows):
                    _, n, comp, node, raw = arrays(t, k, "shingles")
                    sets = [np.frombuffer(s, np.uint64) for s in raw]
                    i, j = dual_traversal([bitmap(s) for s in sets], n, comp, percent)
                    out += [(int(node[x]), int(node[y])) for x, y in spanning_links(sets, comp, i, j, percent)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        full = self.full_sets(docs, open_.select("id").distinct())
        ready = open_.join(full, "id").withColumn("n", (F.length("shingles") / 8).cast("long"))
        return members_of(ready, "shingles").mapInArrow(exact, "a long, b long")

    def uses_of(self, nodes: DataFrame, shared: DataFrame) -> DataFrame:
        """h, salt, id, n: the prefix shingles that may be among the shared ones; a bitmap of fixed size keeps the most others from the shuffle."""
        hot = shared.where(F.col("size") > self.hot).select("h", "size").toArrow()  # 1,024 rows at most
        h = hot["h"].to_numpy()
        parts = -(-hot["size"].to_numpy() // self.hot)
        order = np.argsort(h)
        held = nodes.sparkSession.sparkContext.broadcast((bitset(shared, "h", self.filter_bits), h[order], parts[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, hot_h, hot_parts = held.value
            for b in batches:
                h, sizes = b["prefix"].flatten().to_numpy(), np.diff(b["prefix"].offsets.to_numpy())
                keep = in_bitset(bits, h)
                h, ids, n = h[keep], *(np.repeat(b[c].to_numpy(), sizes)[keep] for c in ("id", "n"))
                salt = np.zeros(len(h), np.int32)
                if len(hot_h):
                    at = np.minimum(np.searchsorted(hot_h, h), len(hot_h) - 1)
                    salt = np.where(hot_h[at] == h, (ids & 0xFFFFFF) % hot_parts[at], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(ids), pa.array(n)], ["h", "salt", "id", "n"])

        return nodes.select("id", "n", "prefix").mapInArrow(run, "h long, salt int, id long, n long")

    def run(self, docs: DataFrame) -> DataFrame:
        docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        sets = saved(self.sets(docs))
        filled = sets.where("id is not null")
        nodes = saved(filled.select("id", "n", "prefix", "bits").dropDuplicates(["id"]))
        uses = nodes.select(F.explode("prefix").alias("h"), "id", "n")
        shared = saved(uses.groupBy("h").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.min_by("n", "id").alias("low_n")).where("size > 1"))
        self.hot = max(self.hot, (shared.agg(F.sum("size")).first()[0] or 0) // 1024)
        parts = F.when(F.col("size") > self.hot, F.ceil(F.col("size") / self.hot)).otherwise(1).cast("int")
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        members = saved(self.uses_of(nodes, shared).join(salted, ["h", "salt"]).select("h", "id", "n", "size", "low", "low_n"))
        # labels that are not yet their component's smallest only spare less work
        joined = star_step(edges(saved(self.star_links(docs, members, nodes))))
        members = members.where("id != low").select("h", "id", "n", "size")  # low was compared with all others
        for _ in range(self.rounds):
            hubs = self.hubs(members, labels_of(joined))
            members = hubs.where("id != low").select("h", "id", "n", "size")
            joined = joined.union(edges(saved(self.star_links(docs, hubs, nodes))))
        labels = components(joined)  # whole ones: what the trees look at grows with the labels in a group
        trees = saved(self.tree_links(docs, members, nodes, labels))
        if trees.limit(1).count():
            labels = components(labels.select(F.col("id").alias("u"), F.col("label").alias("v")).union(edges(trees)))
        first = filled.groupBy("id").agg(F.min("doc_id").alias("first")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        component = first.groupBy("label").agg(F.min("first").alias("component_id"))
        component = first.join(component, "label").select("id", "component_id")
        return sets.select("doc_id", "n", "id").join(component, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text, ...).

    Links are those of a Jaccard similarity of percent or more; component_id is the smallest doc_id reachable by links.
    Nulls: a null text is empty; empty texts have no shingles, link with nothing and are their own component. A row with
    a null doc_id takes part; it gets the component's smallest id, null if all are null. Rows that repeat a doc_id are
    documents of their own. An empty table gives no rows. Other columns are dropped. Shingles are told apart by 64-bit hashes. Texts of any length are whole.
    """
    return Join(**settings).run(docs)


def one_of_each(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is their component's smallest; of rows that repeat it (or have none) each stays."""
    name = next(n for n in (f"_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    found = near_duplicates(docs, **settings).where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, docs["doc_id"] == F.col(name), "left_anti")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))

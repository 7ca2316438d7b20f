"""LM scoring: prediction by partial matching (PPM) over bytes, and the unigram word model as its base.

The pretrained model is a context trie: counts of all runs of order + 1 bytes over all training texts, from which the counts of
the shorter contexts follow. Escapes are estimated by method C (as many as distinct symbols); a symbol that was seen in the
longer context is excluded in the shorter one. So the code length of a byte depends on its run alone. The trie is a set of
tables and has no cap: frequent runs go to the tasks with their code lengths, all others are looked up by joins with the
tables of contexts, order by order. The adaptive model starts empty for each document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent, saved, slices, table, words

START, END = 0xFE, 0xFF  # bytes that UTF-8 never uses: before the text, and its end
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A") : ord("Z") + 1] += 32


def runs(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of order + 1 bytes that end in each byte of the lower-cased texts and in each text's end, and where each text's begin."""
    rows, sizes = len(at) - 1, np.diff(at)
    wide = order + 1
    begin = at[:-1] + wide * np.arange(rows)
    seq = np.full(len(data) + wide * rows, START, np.uint64)
    seq[np.arange(len(data)) + np.repeat(wide * np.arange(rows) + order, sizes)] = TO_LOWER[data]
    seq[begin + order + sizes] = END
    x = seq.copy()
    for k in range(1, wide):
        x[k:] |= seq[:-k] << np.uint64(8 * k)
    keep = np.ones(len(seq), bool)
    for k in range(order):
        keep[begin + k] = False
    return x[keep], at[:-1] + np.arange(rows)


class Low:
    """The orders 2 to 0 of the model: at most 2**24 runs of three bytes, whatever the corpus."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: distinct runs of three bytes."""
        order = np.argsort(keys)
        levels = [(keys[order].astype(np.int64), counts[order].astype(np.float64))]
        for k in (2, 1):
            short, place = np.unique(levels[-1][0] & ((1 << 8 * k) - 1), return_inverse=True)
            levels.append((short, np.bincount(place, levels[-1][1], len(short))))
        self.grams = levels[::-1]  # of 1, 2, 3 bytes
        self.contexts = []  # keys, totals, distinct symbols, and of the next shorter context: the counts of the symbols seen here
        for k, (grams, n) in enumerate(self.grams):
            ctx, place = np.unique(grams >> 8, return_inverse=True)
            excluded = np.zeros(len(ctx))
            if k:
                short, sn = self.grams[k - 1]
                excluded = np.bincount(place, sn[np.searchsorted(short, grams & ((1 << 8 * k) - 1))], len(ctx))
            self.contexts.append((ctx, np.bincount(place, n, len(ctx)), np.bincount(place, minlength=len(ctx)).astype(np.float64), excluded))

    def backed_off(self, keys: np.ndarray, drop_n: np.ndarray, drop_d: np.ndarray) -> np.ndarray:
        """log10 of the last bytes of runs of three or more, by the chain of escapes. drop_n, drop_d: counts and symbols that the next longer context excludes."""
        keys = keys.astype(np.int64)
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        for k in (2, 1, 0):
            gram, (grams, n) = keys & ((1 << 8 * (k + 1)) - 1), self.grams[k]
            ctx, total, distinct, excluded = self.contexts[k]
            if not len(grams):
                continue
            g, c = np.minimum(np.searchsorted(grams, gram), len(grams) - 1), np.minimum(np.searchsorted(ctx, gram >> 8), len(ctx) - 1)
            seen, known = grams[g] == gram, ctx[c] == gram >> 8
            t, d = total[c] - drop_n, distinct[c] - drop_d
            use = open_ & known & (d > 0)
            hit, miss = use & seen, use & ~seen
            out[hit] += np.log10(n[g[hit]] / (t[hit] + d[hit]))
            out[miss] += np.log10(d[miss] / (t[miss] + d[miss]))
            open_ &= ~hit
            drop_n, drop_d = np.where(known, excluded[c], 0.0), np.where(known, distinct[c], 0.0)
        out[open_] -= math.log10(256 - len(self.grams[0][0])) if len(self.grams[0][0]) < 256 else 0.0
        return out


class Lookup:
    """Values by 64-bit keys: open addressing with linear probing, two slots a key at least."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(keys) - 1).bit_length() if len(keys) else 4))
        self.slots = np.full(1 << (64 - int(self.shift)), self.FREE, np.uint64)
        self.values = np.zeros(len(self.slots))
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] == self.FREE
            self.slots[at[free]] = keys[free]  # one of those that want the same slot gets it
            won = self.slots[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 for unknown keys, and which are known."""
        at = self._slot(keys)
        found = self.slots[at] == keys
        out = np.where(found, self.values[at], 0.0)
        left = np.flatnonzero(~found)
        at = at[left]
        while len(left):
            on = self.slots[at] != self.FREE
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
            hit = self.slots[at] == keys[left]
            out[left[hit]] = self.values[at[hit]]
            found[left[hit]] = True
            left, at = left[~hit], at[~hit]
        return out, found


def adaptive_log10(data: bytes, order: int = 3) -> float:
    """log10 of the text and its end by a PPM model that learns each byte after coding it, starting empty."""
    trie: dict[bytes, dict[int, int]] = {}
    total, past = 0.0, b""
    for s in [*data.lower(), END]:
        out: set[int] = set()
        for k in range(min(order, len(past)), -1, -1):
            seen = trie.get(past[len(past) - k :], {})
            left = {x: n for x, n in seen.items() if x not in out}
            if not left:
                continue
            n = sum(left.values()) + len(left)
            if s in left:
                total += math.log10(left[s] / n)
                break
            total += math.log10(len(left) / n)
            out |= left.keys()
        else:
            total -= math.log10(256 - len(out))
        for k in range(min(order, len(past)) + 1):
            node = trie.setdefault(past[len(past) - k :], {})
            node[s] = node.get(s, 0) + 1
        past = (past + bytes([s]))[-order:]
    return total


def adaptive(docs: DataFrame) -> DataFrame:
    """doc_id and score: the adaptive model's log10 probability of each text.

    A null or empty text is its end alone, a null doc_id stays, repeated rows are scored each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([adaptive_log10((t or "").encode()) for t in b["text"].to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


#: Bytes of text whose runs are looked at at a time: each takes some ten numbers of eight bytes.
PART_BYTES = 1 << 18


class Counter:
    """Counts of 64-bit keys: raw keys are summed up when they are many, and the sums leave when these are."""

    RAW, HELD = 1 << 20, 1 << 20

    def __init__(self):
        self.raw, self.size, self.keys, self.n = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> bool:
        """Whether the sums should be taken."""
        self.raw.append(keys)
        self.size += len(keys)
        if self.size >= self.RAW:
            self._sum()
        return len(self.keys) >= self.HELD

    def _sum(self) -> None:
        keys, n = np.unique(np.concatenate([self.keys[:0], *self.raw]), return_counts=True)
        self.raw, self.size = [], 0
        if len(self.keys):
            both, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            n = np.bincount(place, np.concatenate([self.n, n]), len(both)).astype(np.int64)
            keys = both
        self.keys, self.n = keys, n

    def take(self, kind: int) -> pa.RecordBatch:
        self._sum()
        out = pa.RecordBatch.from_arrays([pa.array(np.full(len(self.keys), kind, np.int32)), pa.array(self.keys.view(np.int64)), pa.array(self.n)], ["kind", "key", "n"])
        self.__init__()
        return out


def gather(docs: DataFrame, order: int) -> DataFrame:
    """kind, key, n over the training rows: 0 words by their hash, 1 runs of order + 1 bytes, 2 the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, texts = (Counter(), Counter()), 0
        for b in batches:
            texts += b.num_rows
            for _, _, data, at in slices(b["text"], PART_BYTES):
                for kind, keys in enumerate((words(data, at)[0], runs(data, at, order)[0])):
                    if counters[kind].add(keys):
                        yield counters[kind].take(kind)
        for kind in (0, 1):
            yield counters[kind].take(kind)
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0]), pa.array([texts])], ["kind", "key", "n"])

    rows = docs.where("not held_out").select("text").mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def low(key, size: int):
    """The last bytes of a run."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


class Trie:
    """The tables of the orders 3 and up: runs[size] (key, n) of size bytes, and for each context its totals. Orders 2 to 0 are a Low."""

    def __init__(self, counted: DataFrame, order: int):
        self.order, self.runs = order, {order + 1: counted}
        for size in range(order, 2, -1):
            self.runs[size] = saved(self.runs[size + 1].groupBy(low("key", size).alias("key")).agg(F.sum("n").alias("n")))
        sums = counted.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("t"), F.count("*").alias("d"))
        # key, n, log of all whole runs: the log10 of their last bytes
        self.seen = saved(counted.withColumn("ctx", F.shiftright("key", 8)).join(sums, "ctx").select("key", "n", F.log10(F.col("n") / (F.col("t") + F.col("d"))).alias("log")))
        three = self.runs[3].toArrow()  # 2**24 rows of two numbers at most
        self.low = Low(three["key"].to_numpy(), three["n"].to_numpy())

    def contexts(self, k: int, wanted: DataFrame) -> DataFrame:
        """Of the wanted(ctx): ctx (k bytes), t: their uses, d: distinct next bytes, x: uses of these in the context of k - 1 bytes, after: next byte -> uses, 256 at most."""
        shorter = self.runs[k].select(F.col("key").alias("short"), F.col("n").alias("uses"))
        each = self.runs[k + 1].select(F.shiftright("key", 8).alias("ctx"), low("key", 1).cast("int").alias("next"), "n", low("key", k).alias("short"))
        each = each.join(wanted, "ctx", "left_semi").join(shorter, "short")
        return each.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("uses").alias("x"), F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("after"))

    def known_logs(self, common: int) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent whole runs, at most `common`, and the log10 of their last bytes."""
        got = frequent(self.seen, "n", common).select("key", "log").toArrow()
        return got["key"].to_numpy().view(np.uint64), got["log"].to_numpy()

    def logs(self, keys: DataFrame) -> DataFrame:
        """key, log for distinct whole runs: the log10 of their last bytes, seen or not."""
        found = saved(keys.select("key").join(self.seen.select("key", "log"), "key", "left"))
        return found.where("log is not null").unionByName(self.escaped(found.where("log is null")))

    def escaped(self, keys: DataFrame) -> DataFrame:
        """key, log for distinct runs that were not seen: down the orders, as long as their last byte does not follow the context."""
        q = keys.select("key", F.lit(0.0).alias("log"), F.lit(0.0).alias("drop_n"), F.lit(0.0).alias("drop_d"), F.lit(True).alias("open"))
        for k in range(self.order, 2, -1):
            q = saved(q.withColumn("ctx", F.shiftright(low("key", k + 1), 8)))
            q = q.join(self.contexts(k, q.where("open").select("ctx").distinct()), "ctx", "left")
            n, t, d = F.expr("try_element_at(after, cast(key & 255 as int))"), F.col("t") - F.col("drop_n"), F.col("d") - F.col("drop_d")
            use = F.col("open") & F.col("t").isNotNull() & F.coalesce(d > 0, F.lit(False))
            hit = use & n.isNotNull()
            q = q.select(
                "key", (F.col("log") + F.when(hit, F.log10(n / (t + d))).when(use, F.log10(d / (t + d))).otherwise(0.0)).alias("log"),
                F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("drop_n"), F.coalesce(F.col("d").cast("double"), F.lit(0.0)).alias("drop_d"), (F.col("open") & ~hit).alias("open"),
            )
        shared = keys.sparkSession.sparkContext.broadcast(self.low)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                left, out = np.flatnonzero(b["open"].to_numpy(zero_copy_only=False)), b["log"].to_numpy(zero_copy_only=False).copy()
                out[left] += shared.value.backed_off(*(b[c].to_numpy()[left] for c in ("key", "drop_n", "drop_d")))
                yield pa.RecordBatch.from_arrays([b["key"], pa.array(out)], ["key", "log"])

        return q.mapInArrow(run, "key long, log double")


def score(docs: DataFrame, held_out, order: int = 5, common: int = 1 << 18, common_runs: int = 1 << 20) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. Texts of any length are whole.

    held_out: a boolean column, the rows not to learn from. order: bytes of the longest contexts, 3 to 6. The most frequent words
    (at most `common`) and runs of bytes (at most common_runs) go to the tasks as arrays of that size; all others are looked up by a
    join, so the vocabulary and the trie may be of any size, and both numbers change no result. Words are told apart by 64-bit
    hashes. Nulls: a null text is empty, a null doc_id stays. Repeated rows are scored each. An empty table gives no
    rows; without training texts every byte costs 1/256.
    """
    docs = docs.select("doc_id", held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    counts = saved(gather(docs, order))
    vocabulary = counts.where("kind = 0").select("key", "n")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()}
    texts = sums[2]["n"] if 2 in sums else 0
    n_train = texts + (sums[0]["n"] if 0 in sums else 0)
    n_words = (texts > 0) + (sums[0]["distinct"] if 0 in sums else 0)
    base = n_train + n_words + 1
    top = frequent(vocabulary, "n", common).toArrow()
    trie = Trie(counts.where("kind = 1").select("key", "n"), order)
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(top["key"].to_numpy().view(np.uint64), np.log10((top["n"].to_numpy() + 1) / base)), Lookup(*trie.known_logs(common_runs))))
    end = math.log10((texts + 1) / base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, known_runs = shared.value
        for b in batches:
            for i, j, data, at in slices(b["text"], PART_BYTES):
                rows = j - i
                sums, open_ = [], []
                for kind, table_, (keys, begin) in ((0, known_words, words(data, at)), (1, known_runs, runs(data, at, order))):
                    logs, hit = table_.get(keys)
                    of = np.repeat(np.arange(rows), np.diff(np.append(begin[:rows], len(keys))))
                    sums.append((np.bincount(of, logs, rows), np.bincount(of, minlength=rows), np.bincount(of[hit], minlength=rows)))
                    open_.append((np.full((~hit).sum(), kind, np.int32), of[~hit], keys[~hit]))
                kind, of, keys = (np.concatenate(x) for x in zip(*open_, strict=True))
                sort = np.lexsort((keys, kind, of))
                kind, of, keys = kind[sort], of[sort], keys[sort]
                new = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (of[1:] != of[:-1]) | (keys[1:] != keys[:-1]))[: len(keys)])
                tf = np.diff(np.append(new, len(keys)))
                rare = pa.StructArray.from_arrays([pa.array(kind[new]), pa.array(keys[new].view(np.int64)), pa.array(tf)], ["kind", "key", "tf"])
                starts = np.searchsorted(of[new], np.arange(rows + 1)).astype(np.int32)
                (base_sum, tokens, known), (total, _, _) = sums
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"].slice(i, rows), b["held_out"].slice(i, rows), pa.array(np.diff(at)), pa.array(tokens + 1), pa.array(known + (texts > 0)),
                        pa.array(base_sum + end), pa.array(total), pa.ListArray.from_arrays(pa.array(starts), rare),
                    ],
                    ["doc_id", "held_out", "bytes", "n_tokens", "n_known", "base_score", "score", "rare"],
                )

    schema = "doc_id long, held_out boolean, bytes long, n_tokens long, n_known long, base_score double, score double, rare array<struct<kind:int,key:bigint,tf:bigint>>"
    parts = saved(docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    need = parts.select("row", F.inline("rare"))
    logs = trie.logs(need.where("kind = 1").select("key").distinct()).select(F.lit(1).alias("kind"), "key", "log", F.lit(0).alias("known"))
    logs = logs.unionByName(vocabulary.select(F.lit(0).alias("kind"), "key", F.log10((F.col("n") + 1) / F.lit(float(base))).alias("log"), F.lit(1).alias("known")))
    # a merge join, which Spark splits where a key is hot
    each = need.join(logs.hint("merge"), ["kind", "key"], "left").withColumn("log", F.coalesce("log", F.lit(-math.log10(base))) * F.col("tf"))
    word = F.col("kind") == 0
    more = each.groupBy("row").agg(F.sum(F.when(word & (F.col("known") == 1), F.col("tf"))).alias("more_known"), F.sum(F.when(word, F.col("log"))).alias("more_base"), F.sum(F.when(~word, F.col("log"))).alias("more_score"))
    total = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return parts.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), total.alias("score"), (-total / math.log10(2) / F.greatest(F.lit(1), "bytes")).alias("bits_per_byte"),
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() over all documents; those whose crc32 modulo 7 is 2 are held out, a null doc_id is not."""
    return score(table(spark, sf_dir, "documents"), F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False)))

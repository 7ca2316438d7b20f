"""Line dedup: runs of lines that repeat anywhere in the corpus are removed after a comparison of their bytes.

dedup_runs takes out repeated content-defined chunks, whose borders depend on the two lines beside them alone, and finds the ends of
each repeated run, and runs without a whole chunk, by pairs of lines in what is left. dedup_lines looks at disjoint chunks alone, which is less work, but misses most repeated runs of few lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, bitset, in_bitset, mixed, powers, saved, slices, table

#: A 64-bit value for each byte, case kept.
RAW = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


#: Bits of the bitmap that keeps the texts of most unrepeated chunks from the shuffle.
FILTER_BITS = 1 << 23
#: A line of so many bytes (about 50 words) counts alone as a repeated passage.
LONG = 300
#: One border between two lines in so many ends a chunk.
DIVISOR = 4


@dataclass(frozen=True)
class Chunking:
    """A chunk ends after a line where the hash of this line and the one before is a multiple of divisor, if it has `least` lines; with `most` at the latest."""

    divisor: int = 2
    least: int = 2
    most: int = 16


def chunks(data: np.ndarray, at: np.ndarray, c: Chunking) -> list[list[tuple[int, int, int]]]:
    """For each text its chunks: (first byte, end byte, lines), relative to the text; the line break after a chunk belongs to none."""
    breaks = np.flatnonzero(data == 10)
    counts = np.diff(np.searchsorted(breaks, at)) + 1
    begin = np.concatenate([[0], np.cumsum(counts)])
    start, end = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(RAW[data] * up[:-1], out=sums[1:])
    h = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    rolled = h.copy()
    rolled[1:] += h[:-1] * np.uint64(0x9E3779B97F4A7C15)
    rolled[begin[:-1]] = h[begin[:-1]]  # no text is cut by the last line of another
    cut = mixed(rolled) % np.uint64(c.divisor) == 0
    out = []
    for i, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        own, first = [], lo
        for k in range(lo, hi):
            size = k - first + 1
            # the first line of a chunk may follow anything, so its hash with the line before does not count
            if size >= c.least and (cut[k] or size == c.most) or k == hi - 1:
                own.append((int(start[first] - at[i]), int(end[k] - at[i]), size))
                first = k + 1
        out.append(own)
    return out


def chunked(docs: DataFrame, c: Chunking) -> DataFrame:
    """docs with row and chunks (no, lines, hash); hash is null for chunks of one line or of white space alone."""
    kind = "array<struct<from:int,to:int,lines:int,hash:bigint>>"
    arrow = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lines", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, _, data, at in slices(b["_doc"].field("text")):
                raw = data.tobytes()
                for begin, own in zip(at[:-1].tolist(), chunks(data, at, c), strict=True):
                    row = []
                    for x, y, lines in own:
                        text = raw[begin + x : begin + y]
                        known = lines >= c.least and not text.isspace() and text
                        row.append({"from": x, "to": y, "lines": lines, "hash": int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True) if known else None})
                    found.append(row)
            yield b.append_column("_chunks", pa.array(found, arrow))

    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"))
    schema = T.StructType([*whole.schema.fields, T.StructField("_chunks", T._parse_datatype_string(kind))])
    return saved(whole.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))


def repeats(held: DataFrame) -> DataFrame:
    """_row, removed: the numbers of the chunks of each row that an earlier place (by doc_id, row, number) holds byte for byte."""
    each = held.select("_row", "_id", F.posexplode("_chunks").alias("no", "chunk")).select("_row", "_id", "no", F.col("chunk.hash").alias("hash")).where("hash is not null")
    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row"), "no")
    first = saved(each.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("hash", "first"))
    shared = held.sparkSession.sparkContext.broadcast(bitset(first, "hash", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, text, own in zip(b["_row"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["_chunks"].to_pylist(), strict=True):
                known = [(k, c) for k, c in enumerate(own) if c["hash"] is not None]
                if known:
                    keep = in_bitset(shared.value, np.array([c["hash"] for _, c in known]))
                    out += [(row, k, c["hash"], text[c["from"] : c["to"]]) for (k, c), x in zip(known, keep.tolist(), strict=True) if x]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["_row", "no", "hash", "bytes"])

    texts = held.select("_row", F.coalesce("_doc.text", F.lit("")).alias("text"), "_chunks").mapInArrow(run, "_row long, no int, hash long, bytes binary")
    found = saved(texts.join(first.hint("merge"), "hash"))
    keeper = saved(found.where("_row = first.row and no = first.no").select("hash", F.col("bytes").alias("kept")))
    # a hot hash is a skewed join of two written tables, which Spark splits
    gone = found.where("not (_row = first.row and no = first.no)").join(keeper.hint("merge"), "hash").where("bytes = kept")
    return gone.groupBy("_row").agg(F.collect_set("no").alias("removed"))


def dedup_lines(docs: DataFrame, chunking: Chunking = Chunking(), drop_emptied: bool = False) -> DataFrame:
    """docs with repeated chunks of two or more lines removed from text, and n_lines, removed_lines (both new; clashing columns are replaced).

    The first occurrence by doc_id stays, also within a document; lines are divided by \\n. n_chars, where there is such a column,
    is the new text's length. Nulls: a null text stays null, a null doc_id comes last in order. Repeated rows count as occurrences.
    Chunks of white space alone and single lines stay. drop_emptied drops the rows of which only white space is left, but
    for those that had nothing else before. An empty table gives no rows.
    """
    held = chunked(docs, chunking)
    # a merge join at every size; a side that happens to be small is not broadcast
    joined = held.select("_row", "_doc", "_chunks").join(repeats(held).hint("merge"), "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, gone = [], [], []
            for text, own, removed in zip(b["_doc"].field("text").fill_null("").cast(pa.binary()).to_pylist(), b["_chunks"].to_pylist(), b["removed"].to_pylist(), strict=True):
                out = set(removed or ())
                texts.append(b"\n".join(text[c["from"] : c["to"]] for k, c in enumerate(own) if k not in out) if out else text)
                lines.append(sum(c["lines"] for c in own))
                gone.append(sum(own[k]["lines"] for k in out))
            yield pa.RecordBatch.from_arrays([b["_doc"], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["_doc", "_new", "_lines", "_gone"])

    return finished(docs, joined.select("_doc", "_chunks", "removed").mapInArrow(run, shortened(joined)), drop_emptied)


def shortened(joined: DataFrame) -> T.StructType:
    return T.StructType([joined.schema["_doc"], T.StructField("_new", T.StringType()), T.StructField("_lines", T.LongType()), T.StructField("_gone", T.LongType())])


def finished(docs: DataFrame, done: DataFrame, drop_emptied: bool) -> DataFrame:
    """done (_doc, _new, _lines, _gone) with the columns of docs."""
    if drop_emptied:
        done = done.where("_gone = 0 or _new rlike '[^\\\\s]'")
    new = {"text": F.when(F.col("_doc.text").isNotNull(), F.col("_new")), "n_lines": F.col("_lines"), "removed_lines": F.col("_gone")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_gone") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    kept = [new.pop(c).alias(c) if c in new else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    return done.select(*kept, *(e.alias(c) for c, e in new.items()))


def filled_lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts' lines that are not white space alone: text, number among those of its text, first byte, end byte."""
    breaks = np.flatnonzero(data == 10)
    counts = np.diff(np.searchsorted(breaks, at)) + 1
    start, end = np.sort(np.concatenate([at[:-1], breaks + 1])), np.sort(np.concatenate([breaks, at[1:]]))
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=filled[1:])
    some = filled[end] > filled[start]
    of, start, end = np.repeat(np.arange(len(at) - 1), counts)[some], start[some], end[some]
    return of, np.arange(len(of)) - np.searchsorted(of, of), start, end


def hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of first and end bytes: 64-bit hashes of the pieces of data between them."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(RAW[data] * up[:-1], out=sums[1:])
    return lambda first, last: mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def line_chunks(data: np.ndarray, at: np.ndarray, divisor: int = DIVISOR) -> tuple[np.ndarray, ...]:
    """Of the texts: text, code, first byte, end byte and hash of each content-defined chunk of two or more filled lines, and the chunk of each filled line (-1: none).

    A chunk ends between two lines where a hash of their hashes is a multiple of divisor, and at the ends of the text: a border depends on the
    two lines beside it alone, so it is found again wherever they stand. code is the number of the chunk's first line times 2**32 plus that of its last.
    """
    of, no, start, end = filled_lines(data, at)
    hashes = hasher(data)
    h = hashes(start, end)
    begins = np.ones(len(of), bool)
    begins[1:] = (of[1:] != of[:-1]) | (mixed(h[1:] + h[:-1] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(divisor) == 0)
    a = np.flatnonzero(begins)
    b = np.append(a[1:], len(of))[: len(a)] - 1
    long = b > a
    within = np.repeat(np.where(long, np.cumsum(long) - 1, -1), b - a + 1)
    a, b = a[long], b[long]
    return of[a], no[a] << 32 | no[b], start[a], end[b], hashes(start[a], end[b]).view(np.int64), within


def windows(data: np.ndarray, at: np.ndarray, long: int) -> tuple[np.ndarray, ...]:
    """Of the texts: text, code, first byte, end byte and hash of each two neighbouring lines and each line of at least long bytes, and their first and last places among all filled lines.

    Lines of white space alone are passed over: those between two lines belong to their window. Codes are as in line_chunks.
    """
    of, no, start, end = filled_lines(data, at)
    two, one = np.flatnonzero(of[1:] == of[:-1]), np.flatnonzero(end - start >= long)
    a, b = np.concatenate([two, one]), np.concatenate([two + 1, one])
    return of[a], no[a] << 32 | no[b], start[a], end[b], hasher(data)(start[a], end[b]).view(np.int64), a, b


Pieces = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def repeated(texts: DataFrame, pieces: Pieces) -> tuple[DataFrame, DataFrame, Broadcast]:
    """Which pieces of texts(_row, _id, base, whole, text) an earlier place (by _id, row, code) holds byte for byte.

    pieces gives text, code, first byte, end byte and hash of each from bytes, offsets and whole. base is added to a text's codes.
    (_row, code) of the repeated ones; (_row, _id, base, bytes) of all others that the bitmap of repeated hashes (last) lets pass.
    Two lines do not repeat those that begin one line before: of a line that follows itself the first two stay.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b["whole"].to_numpy(zero_copy_only=False)
            for i, j, data, at in slices(b["text"]):
                h, n = np.unique(pieces(data, at, whole[i:j])[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["hash", "n"])

    again = saved(texts.select("text", "whole").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash"))
    shared = texts.sparkSession.sparkContext.broadcast(bitset(again, "hash", FILTER_BITS))

    def places(with_bytes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                whole, base = b["whole"].to_numpy(zero_copy_only=False), b["base"].to_numpy()
                for i, j, data, at in slices(b["text"]):
                    of, code, first, last, h = pieces(data, at, whole[i:j])[:5]
                    keep = np.flatnonzero(in_bitset(shared.value, h))
                    take = pa.array(of[keep])
                    out = {c: b[c].slice(i, j - i).take(take) for c in ("_row", "_id")} | {"code": pa.array(code[keep] + base[i:j][of[keep]]), "hash": pa.array(h[keep])}
                    if with_bytes:
                        raw = data.tobytes()
                        out["bytes"] = pa.array([raw[x:y] for x, y in zip(first[keep].tolist(), last[keep].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*out.values()], [*out])

        rest = [T.StructField("code", T.LongType()), T.StructField("hash", T.LongType())] + ([T.StructField("bytes", T.BinaryType())] if with_bytes else [])
        return texts.mapInArrow(run, T.StructType([T.StructField("_row", T.LongType()), texts.schema["_id"], *rest]))

    place = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_row").alias("row"), "code")
    first = saved(places(False).groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("hash", "first.row", F.col("first.code").alias("at")))
    found = saved(places(True).join(first.hint("merge"), "hash", "left"))
    keeper = saved(found.where("_row = row and code = at").select("hash", F.col("bytes").alias("kept")))
    # a hot hash is a skewed join of two written tables, which Spark splits
    next_line = (1 << 32) + 1
    later = found.where(f"not (_row = row and (code = at or code >> 32 < code % {1 << 32} and code = at + {next_line}))")
    compared = saved(later.join(keeper.hint("merge"), "hash").select("_row", "_id", "code", F.when(F.col("bytes") != F.col("kept"), F.col("bytes")).alias("bytes")))
    other = found.where("row is null or _row = row and code = at").select("_row", "_id", "code", "bytes").unionByName(compared.where("bytes is not null"))
    base = F.shiftright("code", 32) * F.lit(next_line)
    return compared.where("bytes is null").select("_row", "code"), other.select("_row", "_id", base.alias("base"), "bytes"), shared


def repeated_lines(held: DataFrame, long: int) -> DataFrame:
    """_row, removed: the codes of chunks and windows of each row that an earlier place (by doc_id, row, number) holds byte for byte.

    Repeated chunks go whole; then the runs that begin or end inside a chunk are found by the windows of what is left: of the texts without
    their repeated chunks, of each such chunk once, where it stands first, and of the seams between chunks. A window's first place never
    lies in a chunk that goes, so this finds what the windows of all texts would.
    """
    texts = held.select("_row", "_id", F.lit(0).cast("long").alias("base"), F.lit(True).alias("whole"), F.coalesce("_doc.text", F.lit("")).cast("binary").alias("text"))
    chunks_gone, once, shared = repeated(texts, lambda data, at, whole: line_chunks(data, at))

    def left(data: np.ndarray, at: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows that are not inside a chunk whose hash the bitmap holds; all those of a text that is a chunk."""
        *found, a, b = windows(data, at, long)
        *_, h, within = line_chunks(data, at)
        inside = np.append(in_bitset(shared.value, h), False)[within]
        keep = ~(inside[a] & (within[a] == within[b]) & whole[found[0]])
        return tuple(x[keep] for x in found)

    pieces = texts.unionByName(once.select("_row", "_id", "base", F.lit(False).alias("whole"), F.col("bytes").alias("text")))
    windows_gone = repeated(pieces, left)[0]
    return chunks_gone.unionByName(windows_gone).groupBy("_row").agg(F.collect_set("code").alias("removed"))


def dedup_runs(docs: DataFrame, long: int = LONG, drop_emptied: bool = False) -> DataFrame:
    """docs without repeated runs of lines in text, and n_lines, removed_lines (both new; clashing columns are replaced).

    A line goes where it and a neighbour, or it alone if it has at least long bytes, stand at an earlier place by doc_id, also
    of the same document; so each repeated run of two or more lines goes whole, wherever it begins. Neighbours may have lines of
    white space between them, which have to be the same and go with them. Texts of any length are whole. Nulls, n_chars, repeated rows and drop_emptied are as in dedup_lines.
    """
    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"))
    held = saved(whole.withColumn("_row", F.monotonically_increasing_id()))
    # a merge join at every size; a side that happens to be small is not broadcast
    joined = held.select("_row", "_doc").join(repeated_lines(held, long).hint("merge"), "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, gone = [], [], []
            for text, removed in zip(b["_doc"].field("text").fill_null("").cast(pa.binary()).to_pylist(), b["removed"].to_pylist(), strict=True):
                lines.append(text.count(b"\n") + 1)
                if not removed:
                    texts.append(text)
                    gone.append(0)
                    continue
                own = text.split(b"\n")
                filled = [k for k, x in enumerate(own) if x.strip()]
                out = {k for c in removed for k in range(filled[c >> 32], filled[c & 0xFFFFFFFF] + 1)}
                texts.append(b"\n".join(x for k, x in enumerate(own) if k not in out))
                gone.append(len(out))
            yield pa.RecordBatch.from_arrays([b["_doc"], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], ["_doc", "_new", "_lines", "_gone"])

    return finished(docs, joined.select("_doc", "removed").mapInArrow(run, shortened(joined)), drop_emptied)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated runs of lines."""
    return dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))

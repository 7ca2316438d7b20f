"""Toxicity: a logistic classifier whose training penalises score changes when identity terms of labelled texts are swapped."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Spans, saved, slices, table

#: Fixed values. Groups of identity terms in the languages of the corpus (en, es, fr, de); a term is swapped for the others of its group.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("lesbiana", "heterosexual", "homosexual", "transexual"),
    ("negro", "blanco", "asiático", "africano", "europeo", "árabe"),
    ("musulmán", "cristiano", "judío", "budista", "ateo"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos"),
    ("inmigrante", "refugiado", "extranjero"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("lesbienne", "hétérosexuel", "homosexuel", "transgenre"),
    ("noir", "blanc", "asiatique", "africain", "européen", "arabe"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigré", "réfugié", "étranger"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("lesbisch", "schwul", "heterosexuell", "bisexuell"),
    ("schwarzer", "weißer", "asiate", "afrikaner", "europäer", "araber"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtling", "ausländer"),
)
#: Bytes of words: letters, digits and all of non-ASCII text.
SEPARATOR = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
HEADS = (4, 5, None)  # features are whole words and their first 4 and 5 bytes
SIZE = 1 << 20


def features(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each text the distinct hashed features."""
    spans = Spans(data, at, SEPARATOR)
    columns = [(spans.hashes(m) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44) for k, m in enumerate(HEADS)]
    return [np.unique(np.concatenate([c[lo:hi] for c in columns])).astype(np.int32) for lo, hi in zip(spans.begin[:-1].tolist(), spans.begin[1:].tolist(), strict=True)]


def features_of(texts: Sequence[str]) -> list[np.ndarray]:
    return [f for _, _, data, at in slices(pa.array(texts, pa.string())) for f in features(data, at)]


def swaps(text: str, groups: Sequence[Sequence[str]] = IDENTITY) -> list[str]:
    """The text with each of its identity terms replaced by the next ones of their groups, once for every shift."""
    place = {t: (g, i) for g in groups for i, t in enumerate(g)}
    parts, at, word = [], [], ""
    for c in [*text, " "]:
        if c.isalnum():
            word += c
            continue
        if word:
            if word.lower() in place:
                at.append(len(parts))
            parts.append(word)
        parts.append(c)
        word = ""
    parts.pop()
    if not at:
        return []
    out = []
    for shift in range(1, max(len(place[parts[k].lower()][0]) for k in at)):
        new = list(parts)
        for k in at:
            g, i = place[parts[k].lower()]
            new[k] = g[(i + shift) % len(g)]
        out.append("".join(new))
    return list(dict.fromkeys(x for x in out if x != text))


@dataclass(frozen=True)
class Settings:
    sample: int = 10_000  # distinct (doc_id, text) rows to fit on, at most; the first by a hash of both
    sample_bytes: int = 1 << 26  # of their texts, at most
    least: int = 3  # sampled rows that a feature must be in
    ridge: float = 1e-3
    counterfactual: float = 1.0
    steps: int = 100
    rate: float = 0.1


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by feature
    bias: float
    rows: int = 0  # texts it was fitted on
    pairs: int = 0  # (text, swapped text) of the counterfactual term


class Sparse:
    """Rows of column numbers (flat, and where each row begins), with a sign each if there are signs: products by parts, so that no array of floats of all entries is made."""

    PART = 1 << 18

    def __init__(self, flat: np.ndarray, begin: np.ndarray, width: int, sign: np.ndarray | None = None):
        self.flat, self.begin, self.width, self.sign, self.n = flat, begin, width, sign, len(begin) - 1

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray | float]]:
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.begin, self.begin[i] + self.PART, "right")) - 1)
            a, b = self.begin[i], self.begin[j]
            yield i, j, self.flat[a:b], np.repeat(np.arange(j - i), np.diff(self.begin[i : j + 1])), 1.0 if self.sign is None else self.sign[a:b]
            i = j

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, j, column, row, sign in self.parts():
            out[i:j] = np.bincount(row, sign * w[column], j - i)
        return out

    def transposed(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for i, j, column, row, sign in self.parts():
            out += np.bincount(column, sign * r[i:j][row], self.width)
        return out

    def taken(self, rows: np.ndarray) -> Sparse:
        """Without signs."""
        sizes = np.diff(self.begin)
        return Sparse(self.flat[np.repeat(rows, sizes)], ends(sizes[rows]), self.width)


def ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def flat_lists(lists: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *lists]), ends(np.array([len(x) for x in lists], np.int64))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's scaling, by Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, v = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ v)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        v -= step / max(1.0, np.abs(step).max())
    return float(v[0]), float(v[1])


def kept(flat: np.ndarray, begin: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that have a column, as columns."""
    new = column[flat]
    at = np.concatenate([[0], np.cumsum(new >= 0, dtype=np.int64)])
    return new[new >= 0], at[begin]


def fit(rows: tuple[np.ndarray, np.ndarray], labels: np.ndarray, gains: tuple[np.ndarray, np.ndarray], losses: tuple[np.ndarray, np.ndarray], settings: Settings = Settings()) -> Model:
    """rows: features of the texts, flat and where each text begins; gains, losses: of each swapped text the features that it has more and less, likewise.

    Full-batch Adam on log loss + ridge * |w|^2 + counterfactual * mean (w . (x - x'))^2. Every fifth row is left out and
    serves to calibrate the scores. Without both labels among the rows every score is the share of label 1, smoothed.
    """
    weights, y = np.zeros(SIZE, np.float32), labels.astype(np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    pairs = len(gains[1]) - 1
    if len(set(y.tolist())) < 2:
        return Model(weights, float(np.log(share / (1 - share))) if len(y) else -5.0, len(y), pairs)
    use = np.flatnonzero(np.bincount(rows[0], minlength=SIZE) >= settings.least)
    column = np.full(SIZE, -1, np.int32)
    column[use] = np.arange(len(use))
    test = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or len(set(y[test].tolist())) < 2 or len(set(y[~test].tolist())) < 2:
        test[:] = False
    every = Sparse(*kept(*rows, column), len(use))
    x, left_out = every.taken(~test), every.taken(test)
    del every
    more, less = kept(*gains, column), kept(*losses, column)
    d = Sparse(np.concatenate([more[0], less[0]]), np.zeros(1), len(use))
    if pairs:
        of = np.concatenate([np.repeat(np.arange(pairs), np.diff(more[1])), np.repeat(np.arange(pairs), np.diff(less[1]))])
        sign = np.repeat([1.0, -1.0], [len(more[0]), len(less[0])])
        order = np.argsort(of, kind="stable")
        d = Sparse(d.flat[order], ends(np.bincount(of, minlength=pairs)), len(use), sign[order])
    target, w, bias = y[~test], np.zeros(len(use)), float(np.log(share / (1 - share)))
    m1, m2 = np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    for step in range(1, settings.steps + 1):
        r = (sigmoid(x.times(w) + bias) - target) / x.n
        g = x.transposed(r) + 2 * settings.ridge * w
        if pairs:
            g += 2 * settings.counterfactual / pairs * d.transposed(d.times(w))
        g = np.append(g, r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = settings.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    slope, shift = calibrate(left_out.times(w) + bias, y[test]) if test.any() else (1.0, 0.0)
    weights[use] = w * slope
    return Model(weights, bias * slope + shift, len(y), pairs)


def sampled(docs: DataFrame, labels: DataFrame, may_learn, settings: Settings) -> DataFrame:
    """doc_id, text, toxic, h: the distinct (doc_id, text) of labelled rows to fit on, within both bounds of settings.

    doc_ids are chosen first, by a hash; of their rows, which may be more, as many as fit are kept.
    """
    labels = labels.where("toxic is not null and doc_id is not null").where(may_learn).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = saved(labels.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id"), 33)))
    # of many labels only those that can be among the first go to the task that orders them: twice as many as are wanted
    within = min(1.0, 2 * settings.sample / max(1, labels.count()))
    chosen = labels.where(F.col("place") < int(within * (1 << 31))).orderBy("place", "doc_id").limit(settings.sample).drop("place")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # settings.sample rows of two numbers
    held = saved(texts.withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "h"]))
    first = held.select("doc_id", "h", F.octet_length("text").alias("bytes")).orderBy("h", "doc_id").limit(settings.sample)
    within = F.sum("bytes").over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) <= settings.sample_bytes  # of settings.sample rows
    return held.join(F.broadcast(first.where("bytes is not null").select("doc_id", "h", within.alias("within")).where("within").drop("within")), ["doc_id", "h"])


def learn(docs: DataFrame, labels: DataFrame, may_learn, settings: Settings = Settings(), groups: Sequence[Sequence[str]] = IDENTITY) -> Model:
    """fit() on a bounded sample of the labelled rows that may_learn, a boolean column of labels, allows.

    A null label or doc_id is none; a doc_id that is labelled twice is toxic if one of its labels is. Rows that repeat doc_id and
    text count once, a null text is empty. The features of the sample, of sample_bytes of text at most, are all that the driver gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b["text"][k].as_py()
                (row,) = features_of([text])
                more = features_of(swaps(text, groups))
                gain = [row, *(np.setdiff1d(f, row) for f in more)]
                loss = [row[:0], *(np.setdiff1d(row, f) for f in more)]
                n = len(gain)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b[c][k].as_py()] * n, t) for c, t in (("doc_id", pa.int64()), ("h", pa.int64()), ("toxic", pa.int32()))] + [pa.array(np.arange(n)), pa.array(gain, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int32()))],
                    ["doc_id", "h", "toxic", "swap", "gain", "loss"],
                )

    rows = sampled(docs, labels, may_learn, settings).withColumn("doc_id", F.col("doc_id").cast("long"))
    got = rows.mapInArrow(run, "doc_id long, h long, toxic int, swap long, gain array<int>, loss array<int>").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending"), ("swap", "ascending")]).combine_chunks()
    own = got["swap"].to_numpy() == 0

    def lists(name: str, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = got.filter(pa.array(which))[name].combine_chunks()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        at = x.offsets.to_numpy().astype(np.int64)
        return x.values.to_numpy()[at[0] : at[-1]] if len(x) else np.zeros(0, np.int32), at - at[0]

    texts, gains, losses, toxic = lists("gain", own), lists("gain", ~own), lists("loss", ~own), got["toxic"].to_numpy()[own]
    del got
    return fit(texts, toxic, gains, losses, settings)


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a column of scores; a null text is empty. All other columns stay. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, shift = shared.value
        for b in batches:
            z = [float(w[f].sum(dtype=np.float64)) for _, _, data, at in slices(b["text"]) for f in features(data, at)]
            yield b.append_column(out, pa.array(sigmoid(np.array(z, np.float64) + shift)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, swapped_pairs for each row of documents.

    Rows without text get the score of an empty text; repeated rows are scored each, a null doc_id is not held out. Empty
    tables give no rows. swapped_pairs: the pairs of the fit's counterfactual term.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.lit(model.pairs).cast("long").alias("swapped_pairs"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject (score < 0.5), with all their columns, whatever their names.

    Rows without text get the score of an empty text; repeated rows and null doc_ids are scored like others. Without labels nothing goes.
    """
    model = learn(docs, labels, ~held_out())
    out = next(c for c in ("toxicity", *(f"toxicity_{i}" for i in range(len(docs.columns)))) if c not in docs.columns)
    return scored(docs, model, out).where(F.col(out) < 0.5).drop(out)

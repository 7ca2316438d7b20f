"""Importance resampling, hard negatives and fingerprints against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from nextbasket.llm import negatives, resample, simhash
from nextbasket.llm.common import slices

from .helpers import EDGE, docs, lower, sentence

PART = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# 11 --------------------------------------------------------------------------------------------
def grams(t, longest):
    w = PART.findall(lower(t))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_features_are_checksums_of_word_runs(longest):
    texts = ["", "A b-c", "x" * 100 + " é1 Ü", "a b", "b", "€", "end", "\x00\x7fz 9", "word " * 300, "y" * 64 + "," + "z" * 65]
    for limit in (1, 30, 10000):
        found, n, words = [], [], []
        for _, _, data, at in slices(pa.array(texts), limit):
            f, k, w = resample.features(data, at, longest, 1 << 20)
            found += f.tolist()
            n += k.tolist()
            words += w.tolist()
        want = [[zlib.crc32(g.encode()) % (1 << 20) for g in grams(t, longest)] for t in texts]
        assert n == [len(x) for x in want] and words == [len(PART.findall(lower(t))) for t in texts]
        assert found == [x for t in want for x in t]


def resampled(rows, target, longest, buckets, percent, least):
    of = lambda t: [zlib.crc32(g.encode()) % buckets for g in grams(t, longest)]
    s, t = (collections.Counter(x for text in texts for x in of(text)) for texts in ([t for _, t in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        weight = sum(map(gain, of(text)))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(of(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(PART.findall(lower(text))) >= least))
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    drawn = [(*x[:4], k + 1) for k, x in enumerate(fit[: percent * len(fit) // 100])]
    return sorted(map(str, drawn)), sorted(str((*x[:4], None)) for x in fit[len(drawn) :] + [x for x in out if not x[4]])


@pytest.mark.parametrize("settings", [{}, {"longest": 2, "buckets": 37, "percent": 35, "least": 3}, {"percent": 100, "least": 0}, {"percent": 1}])
def test_resampling_equals_brute_force(spark, settings):
    r = random.Random(4)
    rows = [(i, sentence(r, r.randrange(60))) for i in range(200)] + [(500 + i % 3, "same words " * 12) for i in range(90)] + EDGE
    target = [sentence(r, 40) for _ in range(5)] + [None, ""]
    got = [tuple(x) for x in resample.resample(docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), **settings).drop("n_words").collect()]
    drawn, rest = resampled(rows, target, *({"longest": 1, "buckets": 10000, "percent": 10, "least": 20} | settings).values())
    assert sorted(str(x) for x in got if x[4]) == drawn and sorted(str(x) for x in got if not x[4]) == rest


def test_bracket_is_widened_until_it_holds_the_place(spark):
    scores = spark.range(5000).selectExpr("case when id % 3 = 0 then 7 else cast(pow(id, 1.5) as long) end as score").cache()
    every = sorted((x[0] for x in scores.collect()), reverse=True)
    for place in (1, 2, 499, 3333, 3334, 3400, 5000):
        for width, accuracy in ((0.005, 10000), (1e-9, 2)):
            low, high, above, inside = resample.bracket(scores, place, len(every), width, accuracy)
            assert low <= every[place - 1] <= high and above == sum(x > high for x in every) and inside == sum(low <= x <= high for x in every)


def test_resampling_edges(spark):
    none, target = docs(spark, []), docs(spark, [(1, "a")])
    assert resample.resample(none, target).count() == 0
    got = resample.resample(docs(spark, [(1, "a b"), (2, None)]), none, percent=100, least=0).collect()
    assert {x["rank"] for x in got} == {1, 2} and np.unique([x["n_features"] for x in got]).tolist() == [0, 2]


# 13 --------------------------------------------------------------------------------------------
def print_of(t, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]), 42) for i in range(len(w) - width + 1)] if len(w) >= width else [xxhash.xxh64_intdigest(" ".join(w), 42)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(ids, prints, distance):
    """component_id of each row."""
    comp = list(range(len(prints)))
    p = np.array(prints, np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= distance).tolist():
            a, b = comp[i], comp[j]
            if a != b:
                comp = [a if c == b else c for c in comp]
    least = {c: min((i for i, x in zip(ids, comp) if x == c and i is not None), default=None) for c in set(comp)}
    return [least[c] for c in comp]


def test_fingerprint_is_the_majority_of_shingle_hashes(spark, monkeypatch):
    r = random.Random(2)
    texts = ["", " \n", "one", "A b C", "a b c d", sentence(r, 300), "É x\x00y " * 9, "same " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(array_join(split(text, ' '), ' ')) as h").collect()
    assert [x[0] % 2**64 for x in rows][4] == xxhash.xxh64_intdigest(b"a b c d", 42)  # the hash is Spark's
    for piece in (1 << 20, 1, 7):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert [simhash.fingerprint(t.encode()) for t in texts] == [print_of(t) for t in texts]


def near(r, n, centre, most):
    out = []
    for _ in range(n):
        x = centre
        for b in r.sample(range(64), r.randrange(most + 1)):
            x ^= 1 << b
        out.append(x)
    return out


@pytest.mark.parametrize("settings", [{}, {"hot": 3, "rounds": 1}, {"parts": (2,), "hot": 1000}, {"parts": (4,), "distance": 6}, {"parts": (5,), "distance": 0}, {"parts": (3,), "distance": 3, "hot": 2}])
def test_links_equal_brute_force(spark, monkeypatch, settings):
    r = random.Random(11)
    r64 = lambda: r.getrandbits(64)
    prints = [r64() for _ in range(150)] + [0] * 5 + near(r, 200, r64(), 3) + near(r, 60, r64(), 5)
    for _ in range(40):  # pairs at and just over the distance
        x, d = r64(), settings.get("distance", 4)
        prints += near(r, 1, x, 0) + [x ^ sum(1 << b for b in r.sample(range(64), d)), x ^ sum(1 << b for b in r.sample(range(64), d + 1))]
    prints += [r64() & 0xFFFFFFFF for _ in range(60)] + [p ^ 1 for p in prints[:20]]  # and bits that are always the same
    r.shuffle(prints)
    ids = [None if i % 50 == 7 else i % 400 for i in range(len(prints))]
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in zip(ids, prints)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: table)
    got = simhash.Join(**settings).run(None).collect()
    want = linked(ids, prints, settings.get("distance", 4))
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, f"{p:016x}", c)) for i, p, c in zip(ids, prints, want))


def test_thresholds_spend_the_whole_distance_and_avoid_common_values():
    r = np.random.default_rng(3)
    fp = r.integers(0, 1 << 63, 4000).astype(np.uint64)
    fp[:2000] &= ~np.uint64(0xFFFF)  # half of them have 16 bits in common
    groups = [list(range(k, k + 16)) for k in range(0, 64, 16)]
    counts = [np.bincount(simhash.cells(fp, g), minlength=1 << 16) for g in groups]
    tables = [simhash.expected(c, 16, 4) for c in counts]
    t, cost = simhash.thresholds(fp, groups, tables, 4)
    assert ((t + 1).sum(1) == 5).all() and (t[:2000, 0] == -1).all() and (t[2000:, 0] >= 0).mean() > 0.2
    for i in range(0, 4000, 500):  # the tables count exactly, and no other choice costs less
        for k, g in enumerate(groups):
            d = np.bitwise_count((fp ^ fp[i]) & np.uint64(sum(1 << b for b in g)))
            assert [int(tables[k][s, simhash.cells(fp[i : i + 1], g)[0]]) for s in range(6)] == [0, *((d <= s).sum() for s in range(5))]
        price = lambda k, s: simhash.PROBE_COST * sum(math.comb(16, j) for j in range(s)) + tables[k][s, simhash.cells(fp[i : i + 1], groups[k])[0]]  # noqa: B023, E731
        assert cost[i] == pytest.approx(min(sum(price(k, s) for k, s in enumerate(c)) for c in itertools.product(range(6), repeat=4) if sum(c) == 5))


def test_correlated_bits_share_a_partition():
    r = np.random.default_rng(5)
    x = r.integers(0, 2, (3000, 64))
    x[:, [50, 9, 33]] = x[:, [2]]  # four bits alike
    x[:, 60:] = 0
    ways = simhash.partitions(3000, x.T @ x, 4)
    assert sorted(b for g in ways for b in g) == list(range(64)) and {len(g) for g in ways} == {16}
    assert any({2, 9, 33, 50} <= set(g) for g in ways) and any({60, 61, 62, 63} <= set(g) for g in ways)


def test_fingerprint_edges(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    r = random.Random(6)
    rows = [(i + 10, sentence(r, 200)) for i in range(30)] + [(90, None), *EDGE]
    rows += [(100 + i, t + " more") for i, t in rows[:10]]
    prints = [print_of(t) for _, t in rows]
    want = linked([i for i, _ in rows], prints, 4)
    assert sorted(map(str, map(tuple, simhash.near_duplicates(docs(spark, rows)).collect()))) == sorted(str((i, f"{p:016x}", c)) for (i, _), p, c in zip(rows, prints, want))


# 12 --------------------------------------------------------------------------------------------
def test_curve_visits_each_cell_once_by_single_steps():
    for n, bits in ((1, 4), (2, 4), (3, 3), (5, 2)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        at = negatives.hilbert(grid, bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_intervals_hold_all_products():
    r = np.random.default_rng(1)
    x, a = r.integers(-300, 300, (40, 64)), r.integers(-300, 300, (9, 64))
    least, most = negatives.interval(a, x.min(0)[None], x.max(0)[None])
    assert (least <= (a @ x.T).min(1, keepdims=True)).all() and (most >= (a @ x.T).max(1, keepdims=True)).all()
    big = np.array([[1 << 40, 3]])  # beyond what float64 holds
    assert negatives.product(big, np.array([[1 << 20, 1]])).tolist() == [[(1 << 60) + 3]]


def mined(rows, every=100, positives=5, n=5, low=80, high=100):
    use = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for *_, v in use), default=0)
    q = np.array([v + [0] * (d - len(v)) for *_, v in use], np.int64).reshape(len(use), d)
    out = []
    for k, (i, lab, _) in enumerate(use):
        if i is None or i % every:
            continue
        score = (q @ q[k]).tolist()
        order = sorted((j for j in range(len(use)) if j != k), key=lambda j: (-score[j], use[j][0] is None, use[j][0] or 0))
        for p in [j for j in order if use[j][1] == lab][:positives]:
            fits = [j for j in order if use[j][1] != lab and low * score[p] <= 100 * score[j] <= high * score[p]][:n]
            out += [(i, use[p][0], m + 1, use[j][0], score[p], score[j]) for m, j in enumerate(fits)]
    return sorted(map(str, out))


VECTORS = "id long, label int, embedding array<float>, q string, row long, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, lab, v, None, 1, 0.5) for i, lab, v in rows], VECTORS)


def clustered(r, n, d=12, centres=6, spread=0.15, noise=0.2):
    c = r.normal(size=(centres, d))
    return [(int(i), int(k if r.random() >= noise else r.integers(centres)), [float(np.float32(x)) for x in c[k] + spread * r.normal(size=d)]) for i, k in enumerate(r.integers(centres, size=n))]


@pytest.mark.parametrize("settings", [{}, {"block": 32, "zone": 8, "pack": 4}, {"every": 7, "positives": 3, "negatives": 9, "low": 50, "high": 93, "block": 64}, {"every": 10, "positives": 400, "negatives": 700, "low": -20, "high": 150, "zone": 1}])
def test_mining_equals_brute_force(spark, settings):
    rows = clustered(np.random.default_rng(7), 500)
    rows += [(i + 1000, k, v) for i, k, v in rows[:60]] + [(i, k, v) for i, k, v in rows[:30]]  # equal vectors, repeated rows
    rows += [(700, 1, None), (800, None, [1.0] * 12), (900, 1, [1.0, None]), (901, 1, [float("nan")]), (902, 1, [float("inf")] * 12), (None, 2, rows[5][2]), (300, 1, [0.5, -2.0]), (400, 3, [])]
    got = negatives.mine(vectors(spark, rows), **settings).collect()
    of = {"n" if k == "negatives" else k: v for k, v in settings.items() if k not in ("block", "zone", "pack")}
    assert sorted(str(tuple(x)) for x in got) == mined(rows, **of)


def test_bounds_spare_blocks_of_other_clusters(spark):
    rows = clustered(np.random.default_rng(8), 3000, spread=0.02, noise=0)
    m = negatives.Miner(every=10, block=64, zone=16, pack=8)
    blocks, d = m.blocks(m.points(vectors(spark, rows)))
    anchors = m.anchors(blocks, d)
    packs = m.packs(anchors.selectExpr("*", f"array(struct(-1L as key, lo, {negatives.MOST} as hi)) as windows"))
    read, every = m.wanted(packs, blocks, d, True).count(), packs.count() * blocks.count()
    assert every > 1000 and read < 0.5 * every


def test_mining_edges(spark):
    assert negatives.mine(vectors(spark, [])).count() == 0
    assert negatives.mine(vectors(spark, [(0, None, None)])).count() == 0
    assert negatives.mine(vectors(spark, [(0, 1, []), (1, 1, []), (2, 2, [])])).collect() == [(0, 1, 1, 2, 0, 0)]
    assert negatives.mine(vectors(spark, [(0, 1, [1.0]), (1, 2, [1.0])])).count() == 0  # no positive

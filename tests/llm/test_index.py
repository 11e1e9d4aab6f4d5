"""The compressed index against plain counting, and orders and scores against brute force."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from spanframe.llm import quality, sharding, substring


def test_bit_vector_ranks():
    rng = np.random.default_rng(1)
    for bits in (rng.random(1000) < 0.5, np.repeat(rng.random(12) < 0.5, 100), np.ones(640, bool), np.zeros(1, bool)):
        v = substring.BitVector(bits)
        assert v.ones(np.arange(len(bits) + 1)).tolist() == np.concatenate([[0], np.cumsum(bits)]).tolist()
    assert len(substring.BitVector(np.repeat([True, False], 6400)).words) == 2  # runs take no words


def test_matching_statistics_equal_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(30):
        parts = [rng.integers(1, 4, rng.integers(1, 25)) for _ in range(12)]
        owners = rng.integers(0, 6, 12)
        index = substring.FMIndex(parts, 4, 25)
        got = index.matching_statistics(parts, owners, owners)
        want = []
        for mine, own in zip(parts, owners):
            earlier = {tuple(p[i:j]) for p, o in zip(parts, owners) if o < own for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
            want += [max([n for n in range(1, e + 2) if tuple(mine[e + 1 - n : e + 1]) in earlier], default=0) for e in range(len(mine))]
        assert got.tolist() == want


def test_intervals_are_those_of_windows():
    rng = np.random.default_rng(6)
    parts = [rng.integers(1, 4, rng.integers(5, 40)).astype(np.uint64) for _ in range(20)]
    owners = rng.integers(0, 9, 20)
    for mine, own, spans in zip(parts, owners, substring.repeated_intervals(parts, owners, 5)):
        earlier = {tuple(p[i : i + 5]) for p, o in zip(parts, owners) if o < own for i in range(len(p) - 4)}
        want = {i + k for i in range(len(mine) - 4) if tuple(mine[i : i + 5]) in earlier for k in range(5)}
        assert {w for a, b in spans for w in range(a, b + 1)} == want


def test_interleaving_is_in_fractional_rank_order(spark):
    rng = random.Random(2)
    rows = [(i if i % 11 else None, rng.choice(["a", "b", "b", None]), i) for i in range(90)] + [(5, "a", 5), (5, "a", 5)]
    t = spark.createDataFrame(rows, "doc_id long, source string, n_chars long").repartition(3)
    md5 = lambda i: hashlib.md5(f"0:{'' if i is None else i}".encode()).hexdigest()
    by_source = {}
    for i, s, _ in rows:
        by_source.setdefault("n" if s is None else "s" + s, []).append(md5(i))
    line = sorted((Fraction(2 * r - 1, 2 * len(hs)), s, h) for s, hs in by_source.items() for r, h in enumerate(sorted(hs), 1))
    got = sorted((r.shard, r.slot, "n" if r.source is None else "s" + r.source, md5(r.doc_id)) for r in sharding.interleave(t, 7).collect())
    n = len(rows)
    cuts = [i * 7 // n for i in range(n)]
    want = [(shard, i - cuts.index(shard), s, h) for i, (shard, (_, s, h)) in enumerate(zip(cuts, line))]
    assert got == want


def test_ratios_and_scores_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}é" for i in range(50)]
    rows = [(i, " ".join(rng.choice(words[: 20 if i % 3 else 50]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(60, None), (None, "w1é w2é")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i == 4)) for i in range(30)] + [(7, 1, None)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(30) if i % 3 and i != 4} | {7}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    eight = lambda x: (x % (1 << 64)).to_bytes(8, "little")
    one = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    two = lambda a, b: signed(xxhash.xxh64_intdigest(eight(b), xxhash.xxh64_intdigest(eight(a), 42)))

    def grams(text):
        h = [one(w) for w in (text or "").split()]
        return [x % quality.BUCKETS for x in h] + [two(a, b) % quality.BUCKETS for a, b in zip(h, h[1:])]

    raw, good = {}, {}
    for i, text in rows:
        for g in grams(text):
            raw[g] = raw.get(g, 0) + 1
            good[g] = good.get(g, 0) + (i in trusted)
    n_raw, n_good = sum(raw.values()), sum(good.values())
    expected = {g: n_good * n / n_raw for g, n in raw.items()}
    shrunk = {g: (good[g] + quality.PRIOR) / (expected[g] + quality.PRIOR) for g in raw}
    total = sum(expected[g] * shrunk[g] for g in raw) / n_good
    want = {g: math.log(shrunk[g] / total) for g in raw}
    ratios = quality.fit_ratios(t, labels)
    assert all(ratios[g] == pytest.approx(want.get(g, 0.0), abs=2e-6) for g in range(quality.BUCKETS))
    for r in quality.judge(t, ratios).collect():
        text = dict(rows)[r.doc_id]
        g = grams(text)
        score = sum(ratios[x] for x in g) / len(g) if g else 0.0
        assert r.score == pytest.approx(score, abs=1e-8) and r.kept == (not r.base_failed and round(score, 9) >= quality.THRESHOLD)

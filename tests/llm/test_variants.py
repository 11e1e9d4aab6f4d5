"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from spanframe.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, form string, key int"


def brute_counts(rows, least, often, mutated):
    total = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % mutated == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= often}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(u) + 1 == len(v) and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(rows, least=5, often=3, mutated=97):
    counts = brute_counts(rows, least, often, mutated)
    near = {w: [] for w in counts}
    for u, v in combinations(counts, 2):
        if abs(len(u) - len(v)) < 2 and one_edit(u, v):
            near[u].append(v)
            near[v].append(u)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    t = spark.createDataFrame([(i, t, "mine", 1, "f", 2) for i, t in rows], SCHEMA)
    got = variants.spelling_variants(t.repartition(3), **kw)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, letters, n=200):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 11))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = list(rng.choice(stems[: rng.choice((5, 60))]))
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w) + 1), rng.choice(letters))
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = rng.choice(letters)
            words.append("".join(w))
        rows.append((i, rng.choice([" ", "-", "1", "\n", "×½"]).join(words)))
    return rows


@pytest.mark.parametrize("crowded", [4, 60, 4096])
def test_against_brute_force(spark, crowded):
    """Few letters: many words meet, most keys are crowded and halved."""
    rows = corpus(crowded, "abé")
    assert run(spark, rows, crowded=crowded, mutated=5) == brute(rows, mutated=5)


def test_odd_rows(spark):
    rows = corpus(1, "abcÉß") + [
        (None, "Ünder under Under UNDER"), (7, None), (8, ""), (9, " \n1234"), (10, "÷×÷×÷×÷ ÷×÷×÷×÷ ÷×÷×÷×÷"), (11, "ab" * 3000 + " " + "ab" * 2999 + "b"),
        (12, "İstanbul Kelvin " * 3), (13, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa baaaaa baaaaa baaaaa"), (13, "ab" * 3000 + " " + "ab" * 2999 + "b"), (14, "ab" * 3000 + " " + "ab" * 2999 + "b"),
    ]
    assert run(spark, rows) == brute(rows)


def test_long_texts_are_cut_between_runs(spark, monkeypatch):
    text = "abcde fghij" * 50 + "x" * 500 + " tail" * 9
    monkeypatch.setattr(variants, "PIECE", 7)
    assert "".join(variants._pieces(text)) == text
    runs = [r for p in variants._pieces(text) for r in re.findall("[a-z]+", p)]
    assert runs == re.findall("[a-z]+", text)


def test_few_and_many_are_compared_alike():
    rng = random.Random(2)
    words = list({"pre" + "".join(rng.choice("ab") for _ in range(rng.choice((4, 4, 5)))) for _ in range(60)})
    short = [(w, i + 1, 3, 7) for i, w in enumerate(words) if len(w) == 7]
    longer = [(w, i + 1, 3, 7) for i, w in enumerate(words) if len(w) == 8]
    assert len(short) > 9
    many = variants.verify(short, longer).near
    n = {w: c for w, c, *_ in short + longer}
    short_names = {w for w, *_ in short}
    want = {}
    for u, v in combinations(n, 2):
        if one_edit(u, v) and (u in short_names or v in short_names):
            for x, y in ((u, v), (v, u)):
                want.setdefault(x, []).append(y)
    assert {w: [len(o), *min((-n[x], x) for x in o)] for w, o in want.items()} == {w: [c, -m, x] for w, (c, m, x) in many.items()}


def test_empty_table(spark):
    assert run(spark, []) == []

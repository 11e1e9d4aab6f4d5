"""Prefix tries of conversations against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from spanframe.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, pos string, words long, p1 long"


def rebuilt(rows, family, most):
    said = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(ts)] for c, ts in said.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = said.get(c - c % family, [])[:h] + own[h:]
    return out


def brute(rows, family=20, most=4):
    convs = rebuilt(rows, family, most)
    nodes, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved[path] = saved.get(path, 0) + (len(nodes[path]) - 1) * words
        leaves[path] = leaves.get(path, 0) or 1
        if path:
            up = path[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[path]
            saved[up] = saved.get(up, 0) + saved[path]
    out = []
    for path, members in nodes.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children.get(path, 0), leaves[path], saved[path], sha))
    return sorted(out, key=str)


def run(spark, rows, family=20, most=4):
    t = spark.createDataFrame([(*r, 7, "x", 8, 9) for r in rows], SCHEMA)
    got = tries.prefix_trie(*tries.forked(tries.ordered_turns(t.repartition(3)), family, most))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def talks(seed, n=150, longest=6, choices=2):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        same = rng.random() < 0.3
        for turn in range(3 if same else rng.randint(1, longest)):
            say = 0 if same else rng.randrange(choices)
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"hot {turn} a b" if same else "w " * say + f"{turn}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_nodes", [4, 25, 8192])
def test_against_brute_force(spark, monkeypatch, most_nodes):
    """Few choices: subtries are deep and too large, and are dealt turn by turn."""
    monkeypatch.setattr(tries, "MOST_NODES", most_nodes)
    rows = talks(most_nodes)
    assert run(spark, rows) == brute(rows)


def test_long_conversations_and_cells(spark, monkeypatch):
    monkeypatch.setattr(tries, "MOST_NODES", 30)
    monkeypatch.setattr(tries, "CELL", 7)
    monkeypatch.setattr(tries, "CHUNK", 3)
    # one long path, and a copy of another that is left in the middle
    rows = [(20, t, "u", f"long {t}") for t in range(90)] + [(c, t, "v", f"a a {t}") for c, n in ((40, 80), (60, 50), (80, 50), (100, 80)) for t in range(n)]
    rows += talks(9, 60)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "u", "left out"), (1, None, None, None), (1, 2, "u", "x y"), (1, 2, "u", "x y"), (21, 0, "u", "21 has no turn left"), (22, 0, "u", None), (2, 5, "", "\t\n"),
        (0, -3, "user", "first"), (0, -1, "us", "erfirst"), (7, 0, "user", "first"), (7, 1, "use", "rfirst"), (1 << 60, 0, "u", "far"),
    ]
    assert run(spark, rows) == brute(rows)
    assert any(len(t) == 0 for t in rebuilt(rows, 20, 4).values())


def test_only_turnless_and_empty(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    assert run(spark, [(c, 0, "u", "gone")]) == brute([(c, 0, "u", "gone")])
    assert run(spark, []) == []

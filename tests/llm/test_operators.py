"""Operators against brute force, on small tables with nulls, ties and clashing names."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.llm import decontam, html_text, jaccard, mixing, quality, sharding, substring, token_counts, token_files, warc
from spanframe.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies long, shard int, _rank int"
SPACE = " \t\n\r\x0b\x0c"


def vocabulary(n=40):
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(n)]


def corpus(n=120, seed=1):
    """Texts with exact and near copies, shared passages, odd ones and nulls."""
    rng = random.Random(seed)
    words = vocabulary(400)
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage, texts = say(40), []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.4 and texts:
            copy = (rng.choice(texts) or "a").split()
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        elif kind < 0.6:
            a, b = sorted(rng.sample(range(41), 2))
            texts.append(" ".join(say(rng.randint(0, 30)) + passage[a:b] + say(rng.randint(0, 30))) or "x")
        else:
            texts.append(rng.choice(SPACE).join(say(rng.randint(1, 150))))
    texts += [None, "", " \n\t ", "one", "one two", "Ünï cödé", "long " * 3000 + " ".join(say(200))]
    rows = [(i, t, "en", rng.choice(["a", "b", "b", "b", None]), 0, 7, 7, 7) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def words_of(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- mixing


def test_mix_matches_targets_and_is_stable(spark, docs):
    sized = docs.selectExpr("*", "cast(length(coalesce(text, '')) as long) as size")
    rows = mixing.mix(sized, "size").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    total, sizes, weights = 0, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        total += r["size"]
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (1, 2, 3)[i % 3]
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_:
        rest = total - sum(target[s] for s in sizes if s not in open_)
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3 * sizes[s] if over else weights[s] * level
        open_ = open_ - over if over else set()
    largest = max(r["size"] for r in rows)
    for s in sizes:
        mine = [r for r in rows if r.source == s]
        assert mine[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in mine) - target[s]) <= largest
        n = sum(r.copies for r in mine)
        assert abs(n - len(mine) * target[s] / sizes[s]) <= 1
    assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in rows)
    assert sorted(mixing.mix(sized.repartition(5), "size").collect()) == sorted(rows)
    emitted = mixing.emit(sized.select("doc_id", "source", "size"), size="size")
    assert emitted.count() == sum(r.copies for r in rows)


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark).selectExpr("*", "1L as size"), "size").count() == 0
    zero = spark.createDataFrame([(1, "a", 0), (2, None, None)], "doc_id long, source string, size long")
    assert [r.taken for r in mixing.mix(zero, "size").collect()] == [0, 0]


# ---------------------------------------------------------------- token counts


def test_token_counts_are_greedy_longest_matches(spark, docs, tmp_path):
    import base64

    rng = random.Random(3)
    pieces = {bytes([b]) for b in range(256)} | {b" " + w.encode()[: rng.randint(1, 4)] for w in vocabulary()} | {w.encode()[-rng.randint(1, 4) :] for w in vocabulary()}
    path = tmp_path / "pieces.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(sorted(pieces))))

    def greedy(word):
        n = i = 0
        while i < len(word):
            i += next(k for k in range(8, 0, -1) if word[i : i + k] in pieces and i + k <= len(word))
            n += 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, str(path)).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (len(words_of(r.text)), sum(greedy(b" " + w) for w in words_of(r.text)))
    assert token_counts.count_tokens(empty(spark), str(path)).count() == 0


def test_automaton_without_cover():
    a = token_counts.Automaton([b"a", b"ab", b"abcd", b"c"])
    assert [a.count(w) for w in (b"abc", b"abcd", b"abcdab", b"d", b"", b"abd")] == [2, 1, 2, None, 0, None]


# ---------------------------------------------------------------- quality


def test_base_rules(spark, docs):
    got = {r.doc_id: r for r in quality.base_stats(docs.withColumn("n_words", docs.shard)).collect()}
    for r in docs.collect():
        text, words = r.text or "", [w.decode() for w in words_of(r.text)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(set(windows)) < len(windows) else set()
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert (g.n_dup_lines, g.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert g.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))


def test_ratio_tells_trusted_from_other_text(spark):
    rng = random.Random(2)
    good, bad = vocabulary(60), [w.upper() + "!!" for w in vocabulary(60)]
    rows = [(i, " ".join(rng.choice(bad if i % 4 == 0 else good) for _ in range(80))) for i in range(80)] + [(80, None), (None, "x y")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(40)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    ratios = quality.fit_ratios(t, labels)
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word_hash = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    counts = [np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)]
    for i, text in rows:
        for w in (text or "").split():
            counts[0][signed(word_hash(w)) % quality.BUCKETS] += 1
            counts[1][signed(word_hash(w)) % quality.BUCKETS] += i is not None and i < 40 and i % 4 != 0
    single = [b for b in np.flatnonzero(counts[0]) if counts[0][b] > 0][0]
    assert ratios[single] != 0
    got = {r.doc_id: r for r in quality.judge(t, ratios).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i in range(80))
    assert not got[80].kept and got[80].score == 0.0 and not got[None].kept
    assert {r.doc_id for r in quality.accepted(t, labels).collect()} == {i for i in range(80) if i % 4}
    assert quality.fit_ratios(t, labels.limit(0)) == [0.0] * quality.BUCKETS
    assert quality.quality(t.limit(0), labels).count() == 0


def test_score_is_the_mean_ratio(spark):
    ratios = [i / 1000 for i in range(quality.BUCKETS)]
    t = spark.createDataFrame([(1, "p q p q r")], "doc_id long, text string")
    grams = spark.sql("select array(pmod(xxhash64('p'),65536), pmod(xxhash64('q'),65536), pmod(xxhash64('r'),65536), pmod(xxhash64(xxhash64('p'),xxhash64('q')),65536), pmod(xxhash64(xxhash64('q'),xxhash64('p')),65536), pmod(xxhash64(xxhash64('q'),xxhash64('r')),65536)) g").first().g
    want = sum(ratios[b] * n for b, n in zip(grams, (2, 2, 1, 2, 1, 1))) / 9
    assert quality.judge(t, ratios).first().score == pytest.approx(want)


# ---------------------------------------------------------------- html


@pytest.mark.parametrize(
    "source, text",
    [
        ("<p>a<p>b <b>c</b>&amp;d", "a\n\nb c&d"),
        ("x<br>y<div>z</div>w", "x\ny\nz\nw"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>d", "- a\n- b\n\n  3. c\n\nd"),
        ("<table><tr><th>n<th>q<tr><td>apple<td>1</table>", "n      q\napple  1"),
        ("<table><td>a<td>b<tr><td colspan=2>wide cell<tr><td>x<td>y</table>t", "a  b\nwide cell\nx  y\n\nt"),
        ("<p hidden>a</p><p style='display : none'>b</p><script>'<p>c'</script><head><title>t</title></head>d", "d"),
        ("<pre>  a\n   b</pre>c", "  a\n   b\n\nc"),
        ("a</b></div>b <unclosed", "ab"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<details><summary>s</summary>h</details><dl><dt>t<dd>d</dl>", "s\n\nt\n  d"),
        ("<blockquote>q</blockquote><!-- c --><q>r</q> < 3", '  q\n\n"r" < 3'),
        ("", ""),
    ],
)
def test_render(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<pre><div>a</div><div>  b</div></pre>", "a\n  b"),
        ("<pre>  x\n<ul><li>y</ul></pre>z", "  x\n\n- y\n\nz"),
        ("<listing><div>a</div>  b</listing>", "a\n  b"),
        ("<pre><table><td>a<td>b</table></pre>", "a  b"),
        ("<pre>\t \n</pre>a", "a"),
    ],
)
def test_render_blocks_in_pre(source, text):
    assert html_text.render(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<table><tr><form><td>a</td><td>b</td></form></tr><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr>text<td>x<td>y</table>", "text\nx  y"),
        ("<table><tr><div>u<table><td>v</table></div><td hidden>h<td>x</table>", "u\n\nv\nx"),
        ("a <svg><title>t</title><defs/><path d='M0'/><text>b</text><g><text>c<tspan>d</tspan></text></g>z</svg> e", "a b cd e"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>", "x=1"),
        ("<svg><path><p>after</p>", "after"),
        ("<svg><foreignObject><div>in</div></foreignObject></svg>", "in"),
    ],
)
def test_render_all_visible_text(source, text):
    assert html_text.render(source) == text


def test_render_deep_and_wide():
    assert html_text.render("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert html_text.render("<p title='" + "a" * 10) == ""


def test_extract_text(spark):
    t = spark.createDataFrame([(1, "u", "<p>a", "n"), (2, None, None, "n"), (None, "u", "", "n"), (1, "u", "<p>a", "n")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_text.extract_text(t).collect()), key=str)
    assert got == sorted([(1, "a", 1), (2, "", 0), (None, "", 0), (1, "a", 1)], key=str)
    assert html_text.extract_text(t.limit(0)).count() == 0


# ---------------------------------------------------------------- jaccard


def brute_components(rows, n, percent):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components(spark, docs, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words=n, percent=percent).collect()}
    assert got == brute_components([tuple(r) for r in docs.collect()], n, percent)


def test_jaccard_when_all_tokens_are_frequent(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "frequent_cells", lambda docs, n: np.ones(1 << jaccard.COUNTER_BITS, bool))
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(40):
        w = base[: rng.choice((60, 75, 80, 130))]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(t, words=1).collect()}
    assert got == brute_components(rows, 1, 90)


def test_jaccard_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(80))
    rows = [(5, same), (None, same), (7, same + " x"), (7, "other words here"), (9, "OTHER words\there"), (5, same), (3, None), (4, "")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(t).collect()), key=str)
    assert got == sorted([(5, 5), (None, None), (7, 5), (7, 5), (9, 5), (5, 5), (3, 3), (4, 4)], key=str)
    kept = [r.doc_id for r in jaccard.drop_similar(t).collect()]
    assert sorted(kept, key=str) == sorted([5, None, 3, 4], key=str)
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_missing_tokens_cannot_break_all_keys():
    rng = np.random.default_rng(4)
    for n in (1, 5, 20, 72, 73, 80, 81, 200):
        for _ in range(20):
            tokens = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2)
            e = jaccard.missing(n, 90)
            flags = {int(t): rng.random() < 0.7 for t in tokens}
            other = np.sort(rng.choice(tokens, n - e, replace=False))
            extra = rng.integers(0, 1 << 63, max(0, (n - e) * 100 // 90 - n + 0), dtype=np.uint64)
            other = np.unique(np.concatenate([other, extra]))
            a, b = (jaccard.keys(x, np.array([flags.get(int(t), False) for t in x], bool), 90) for x in (tokens, other))
            both = len(np.intersect1d(tokens, other))
            if jaccard.linked(both, len(tokens) + len(other), 90):
                assert len(np.intersect1d(a, b))


# ---------------------------------------------------------------- substring dedup


def brute_removal(rows, length):
    texts = [(i, words_of(t)) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, substring.LAST), substring.LAST if i is None else i)
    out = []
    for i, w in texts:
        gone = {k + j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < (substring.LAST if i is None else i) for j in range(length)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [13, 6])
def test_remove_repeats(spark, docs, length):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(None, rows[0][1]), (None, rows[1][1]), (rows[2][0], rows[2][1]), (rows[3][0], rows[4][1])]
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring.remove_repeats(t, length=length).collect()), key=str) == brute_removal(rows, length)


def test_remove_repeats_bounds_a_block(spark, monkeypatch):
    # one passage in every document, each time between other words
    rng = random.Random(3)
    words = vocabulary(300)
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage = say(20)
    rows = [(i, " ".join(say(20) + passage[i % 3 :] + say(20))) for i in range(60)] + [(None, " ".join(passage))]
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes, search = [], substring.search_shards

    def watched(distinct, length):
        sizes.extend(r[0] // substring.PACKED for r in distinct.groupBy("key").agg(F.sum(F.length("words")).alias("n")).select("n").collect())
        return search(distinct, length)

    monkeypatch.setattr(substring, "BLOCK_WORDS", 200)
    monkeypatch.setattr(substring, "search_shards", watched)
    assert sorted(map(tuple, substring.remove_repeats(t).collect()), key=str) == brute_removal(rows, 13)
    assert max(sizes, default=0) <= 200


def test_fm_index_counts_occurrences():
    rng = np.random.default_rng(7)
    parts = [rng.integers(1, 5, rng.integers(6, 40)) for _ in range(30)]
    index = substring.FMIndex(parts, 5, 6)
    joined = [tuple(p) for p in parts]
    count = lambda w: sum(p[i : i + 6] == w for p in joined for i in range(len(p) - 5))
    places = np.concatenate([index.starts[i] + np.arange(len(p) - 5) for i, p in enumerate(parts)])
    low, high = index.intervals(places, 6)
    for p, a, b in zip(places, low, high):
        n = count(tuple(index.text[p : p + 6]))
        assert (b - a == n) if n > 1 else (b - a <= 1)


def test_remove_repeats_of_nothing(spark):
    assert substring.remove_repeats(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed, r.kept_text) for r in substring.remove_repeats(one, with_text=True).collect()} == {(1, 0, ""), (2, 0, "a b")}


# ---------------------------------------------------------------- sharding


def test_interleave(spark, docs):
    rows = sharding.interleave(docs, 5).collect()
    assert len(rows) == docs.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    sizes = sorted(map(len, by_shard.values()))
    assert sizes[-1] - sizes[0] <= 1 and set(by_shard) == set(range(5))
    for mine in by_shard.values():
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    for s in {r.source for r in rows}:
        n = [sum(r.source == s for r in mine) for mine in by_shard.values()]
        assert max(n) - min(n) <= 2
    assert sorted((r.doc_id, r.shard, r.slot) for r in sharding.interleave(docs.repartition(7), 5).collect()) == sorted((r.doc_id, r.shard, r.slot) for r in rows)
    assert sharding.interleave(empty(spark), 5).count() == 0


# ---------------------------------------------------------------- decontamination


def test_leaks(spark):
    item = "Anna Smith walked with Tom Brown for 12 miles and then Anna Smith rested for 3 hours before dinner."
    far = "nothing of the kind is said in this other item about the sea and the shore"
    bench = spark.createDataFrame([(1, item, "x"), (2, far, "x"), (3, None, "x"), (4, "too short", "x")], "item_id long, text string, doc_id string")
    swap = item.replace("Anna", "Mary").replace("12", "40").replace("3", "seven")
    rows = [
        (1, "before " + item + " after"), (2, swap), (3, swap.replace("then Mary Smith", "then Tom Smith")), (4, "A clean text that has some words of the item but not in its order at all, dinner before."),
        (5, None), (6, ""), (7, "X " * 50), (None, far), (8, far.upper()),
    ]
    t = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", __import__("pyspark").sql.functions.lit(9))
    got = {(r.doc_id, r.item_id): r.changed for r in decontam.find_leaks(t, bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (None, 2): False}
    assert {r.doc_id for r in decontam.decontaminate(t, bench).collect()} == {3, 4, 5, 6, 7, 8, None}
    assert decontam.find_leaks(t.limit(0), bench).count() == 0 and decontam.find_leaks(t, bench.limit(0)).count() == 0


def test_leaks_of_short_items_and_of_items_of_placeholders(spark):
    sums, names = "What is 12 + 45 + 78 + 90?", "Add 1 2 3 4 5 6 7 8 9 10 Anna Smith Tom Brown 11 12 13"
    bench = spark.createDataFrame([(1, sums), (2, names), (3, "Who wrote it?"), (4, "= ?"), (5, "")], "item_id long, text string")
    cut = names.replace("8 9", "8 and 9")
    rows = [
        (1, "so WHAT is 12 + 45 + 78 + 90, then"), (2, sums.replace("45", "46")), (3, f"x y z {names}. {names}"), (4, cut), (5, "he asked who wrote it"),
        (6, names[:30]), (6, "- - - " + names[26:]), (7, "who wrote this, is = ? asked"), (None, names[:36]), (None, names[22:]),
    ]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_slots, r.changed) for r in decontam.find_leaks(t, bench).collect()} == {(1, 1, 0, False), (3, 2, 0, False), (5, 3, 0, False), (7, 4, 0, False)}
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(t, bench).collect()) == [0, 0, 2, 4, 6, 6]


def test_leaks_in_other_case_and_context(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Anna Smith walked with Tom Brown for 12 miles and then Anna Smith rested for 3 hours before dinner.")], "item_id long, text string")
    short, long = (r.text for r in bench.orderBy("item_id").collect())
    rows = [
        (1, f"asked here {short}"), (2, f"asked here {short.replace('France', 'Spain')}"), (3, short.upper()), (4, long.upper()), (5, long.lower()), (6, long.title()),
        (7, f"X {long} Y"), (8, long.replace("then Anna", "then Mary").lower()), (9, long.replace("Anna", "Eve").replace("and then Eve", "and then Tom")), (10, "What is the price of France?"),
    ]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.changed) for r in decontam.find_leaks(t, bench).collect()}
    assert {k: v for k, v in got.items() if k[1] == 1} == {(1, 1): (1, False), (2, 1): (1, True), (3, 1): (1, False)}
    assert {k: v for k, v in got.items() if k[0] in (4, 5, 6, 7)} == {(k, 2): (9, False) for k in (4, 5, 6, 7)}
    assert set(got) - {(8, 2)} == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2), (7, 2)}


# ---------------------------------------------------------------- warc


def test_warc_round_trip(spark):
    big, mark = "ü" * 600, "\x1f\x8b\x08" * 500
    rows = [(1, "http://a/ b\n", big), (2, None, big), (3, "u", big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""), (8, "u", mark), (None, "u", big), (9, "u", "WARC/1.1\r\n\r\n" * 90)]
    rows += [(i, f"http://x/{i}", "".join(random.Random(i).choice("abc <>") for _ in range(3000))) for i in range(10, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write_warc(pages, scratch(spark, "warc"))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        keeper = max(k for k, _, x in rows if k is not None and x == h) if len(body) >= 1000 else None
        again = keeper is not None and keeper != i
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keeper if again else None))
    for split in (1 << 20, 3000, 57):
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(files, split=split).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    whole = {r.page_id: r.payload for r in warc.read_warc(files, payloads=True).collect() if r.record_type == "response"}
    assert bytes(whole[8]).decode() == mark and whole[6] == b""
    assert warc.round_trip(spark, pages.limit(0), scratch(spark, "warc")).count() == 0


def test_reader_passes_over_damage(tmp_path):
    import pyarrow.fs as pafs

    def member(b):
        s = zlib.compressobj(6, zlib.DEFLATED, 31)
        return s.compress(b) + s.flush()

    rec = lambda i: member(warc.record(i, "u", b"<p>%d" % i, hashlib.sha1(b"<p>%d" % i).hexdigest(), 4, None))
    broken = bytearray(rec(2))
    broken[30] ^= 255
    path = tmp_path / "x.gz"
    path.write_bytes(b"junk" + rec(1) + bytes(broken) + rec(3) + member(b"no record") + rec(4) + b"\x1f\x8b\x08")
    fs, p = pafs.FileSystem.from_uri(path.as_uri())
    size = path.stat().st_size
    for step in (size, 40):
        with fs.open_input_file(p) as f:
            got = [warc.parse_record(d)[0] for a in range(0, size, step) for d in warc.owned_records(f, a, a + step)]
        assert got == [1, 3, 4]


# ---------------------------------------------------------------- token files


@pytest.mark.parametrize("bits", [False, True])
def test_blocks_round_trip(bits):
    rng = np.random.default_rng(1)
    for dtype in ("<u2", "<u4"):
        for n in (1, 7, 8, 1000):
            ids = rng.integers(0, np.iinfo(dtype).max, n).astype(dtype)
            assert (token_files.unpack_block(token_files.pack_block(ids, bits), n, dtype, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, docs, bits):
    from tokenizers import Tokenizer

    from spanframe.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = [(1000, "It's I'LL 3.5kg <|endoftext|>x <|ENDOFTEXT|> a., b.. é. ñ, 12. x\x00y ΣΑΣ. İ \x1c \x85 'S. a'T, ..."), (1000, "b"), (1000, "b")]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + odd
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = token_files.write_token_files(t, scratch(spark, "ids"), path, bits=bits, rows_per_file=20)
    assert manifest.count() > 2
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in token_files.read_token_files(manifest).collect())
    want, at = [], 0
    encoded = [(i, tok.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in rows]
    for i, ids in sorted(encoded, key=lambda r: (r[0], len(r[1]))):
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), at))
        at += len(ids)
    assert got == sorted(want)


def test_token_files_of_odd_tables(spark):
    from spanframe.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    assert token_files.token_output(spark, empty(spark), path).count() == 0
    t = spark.createDataFrame([(None, None), (4, "")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.start, r.n_tokens) for r in token_files.token_output(spark, t, path).collect()) == [(False, 1, 1), (True, 0, 1)]


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = vocabulary(500)
    texts = [" ".join(rng.choice(words) for _ in range(100)) for _ in range(60)]
    item = " ".join(rng.choice(words) for _ in range(20))
    near = texts[3].split()
    near[50] = "changed"
    texts += [texts[1], " ".join(near), texts[5] + " " + item, "short text", None, "same words again and " * 30]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts)], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        left.append(sorted(r.doc_id for r in docs.collect()))
        assert i == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left[0] == list(range(63))
    groups = brute_components([(i, t) for i, t in enumerate(texts[:63])], 5, 80)
    assert left[1] == [i for i in range(63) if groups[i][1] == i] and 60 not in left[1] and 61 not in left[1]
    assert left[2] == [i for i in left[1] if i != 62]
    assert set(left[3]) <= set(left[2]) and left[4] == left[3]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == left[3]

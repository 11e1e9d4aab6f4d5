"""Spelling variants: words one edit apart, and the most frequent form of each.

Words one edit apart agree in all but a window of their positions. An even
partition cuts a word of length L into the windows [0, L/2) and [L/2, L): if one
code point is replaced, all outside one of them is equal, and a word that is one
longer agrees with what lies outside after a shift by one behind the window. So
every word is indexed under what each window leaves, and probed under the same
keys and, shifted, under those of words one shorter. Words that meet under a key
are candidates; a pair counts in the one window that holds its edit, hence once,
and only after the edit was verified.

A key with more than ``CROWDED`` rows is partitioned again: its window is halved, so
that its words are spread over longer keys, down to a window of one position, where
the alphabet bounds what can meet.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import combinations, product
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.llm.common import join_sized, materialize, release

#: Fewest code points and occurrences of a word.
MIN_LENGTH, MIN_COUNT = 5, 3
#: A run loses a code point where this divides its hash.
MUTATED = 97
#: Rows of a key that one task compares.
CROWDED = 4096
#: Code points searched at once; words that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 300_000
#: Keys that are hot enough to be split and few enough to be broadcast (8 bytes each).
FEW_KEYS = 100_000

_OUTSIDE = re.compile("[^A-Za-zÀ-ÿ]")


# ---------------------------------------------------------------- words


def _pieces(text: str) -> Iterator[str]:
    """A text in parts of about ``PIECE`` code points, cut between runs of letters."""
    at = 0
    while len(text) - at > PIECE:
        stop = _OUTSIDE.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _count(batches: Iterator[pa.RecordBatch], least: int, mutated: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")  # shorter runs can make no word
    total: Counter = Counter()

    def rows():
        found = [(w, n) for w, n in total.items() if n and len(w) >= least]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            ids, texts = (c.slice(at, 256).to_pylist() for c in batch.columns)
            for doc, text in zip(ids, texts, strict=True):
                seed = crc32(f"{'' if doc is None else doc}:".encode())
                for piece in _pieces(text or ""):
                    words = runs.findall(piece.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))  # bytes.lower folds A-Z only
                    total.update(words)
                    hashes = {w: h for w in set(words) if (h := crc32(w.encode(), seed)) % mutated == 0}
                    if hashes:
                        for w, n in Counter(filter(hashes.__contains__, words)).items():
                            cut = hashes[w] % len(w)
                            total[w] -= n
                            total[w[:cut] + w[cut + 1 :]] += n
                if len(total) > HELD:
                    yield rows()
    yield rows()


def count_words(docs: DataFrame, least: int = MIN_LENGTH, often: int = MIN_COUNT, mutated: int = MUTATED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the distinct words with at least ``least`` code points and ``often``
    occurrences. Runs of letters are lower-cased in A-Z only; where ``mutated`` divides
    the crc32 of "id:run", the run loses the code point at crc32 % length. A null id
    counts as an empty one, a null text has no words."""
    counts = docs.select(F.col(id).cast("string"), F.col(text).cast("string")).mapInArrow(partial(_count, least=least, mutated=mutated), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


# ---------------------------------------------------------------- windows and keys


def _row(word: Column, longer: bool, start: Column, end: Column) -> Column:
    """A word under the key of window [start, end) of words of its length, or of one less."""
    length = F.length(word) - int(longer)
    head, tail = word.substr(F.lit(1), start), word.substr(end + 1 + int(longer), F.length(word))
    return F.struct(F.xxhash64(length, start, end, head, tail).alias("key"), start.alias("a"), end.alias("b"), F.lit(longer).alias("longer"))


def _first_rows(words: DataFrame, least: int) -> DataFrame:
    w = F.col("word")
    rows = []
    for longer in (False, True):
        length = F.length(w) - int(longer)
        half = F.floor(length / 2).cast("int")
        rows += [F.when(length >= least, _row(w, longer, a, b)) for a, b in ((F.lit(0), half), (half, length))]
    return words.select("word", "n", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))


def _halved(rows: DataFrame) -> DataFrame:
    """Rows of crowded keys under the keys of both halves of their window."""
    a, b, w = F.col("a"), F.col("b"), F.col("word")
    half = F.floor((a + b) / 2).cast("int")
    both = [F.array(_row(w, longer, a, half), _row(w, longer, half, b)) for longer in (False, True)]
    return rows.select("word", "n", F.inline(F.when(F.col("longer"), both[1]).otherwise(both[0])))


def candidate_rows(words: DataFrame, least: int = MIN_LENGTH, crowded: int = CROWDED) -> list[DataFrame]:
    """Materialized rows (word, n, key, a, b, longer): words that are one edit apart
    meet under the key of the one window that holds the edit. In no frame has a key
    over ``crowded`` rows, unless its window is one position. Each round halves the
    windows of crowded keys, so there are at most log2 of the longest word."""
    now, ready = materialize(_first_rows(words, least), "variant-keys"), []
    while True:
        hot = materialize(now.where("b - a > 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("key", F.lit(True).alias("hot")), "crowded")
        if hot.isEmpty():
            release(hot)
            return [*ready, now]
        marked = join_sized(now, hot, ["key"], "left", FEW_KEYS).withColumn("hot", F.col("hot").isNotNull() & (F.col("b") - F.col("a") > 1))
        marked = materialize(marked, "variant-keys")
        ready.append(materialize(marked.where(~F.col("hot")).select(*now.columns), "variant-keys"))
        halved = materialize(_halved(marked.where("hot")).select(*now.columns), "variant-keys")
        release(now, marked, hot)
        now = halved


# ---------------------------------------------------------------- verification


def _parting(u: str, v: str) -> int:
    """The number of code points that two words have in common at their start."""
    low, high = 0, min(len(u), len(v))
    if high < 64:
        for low in range(high):
            if u[low] != v[low]:
                return low
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if u[low:mid] == v[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Found:
    """What the pairs of a key tell about its words."""

    def __init__(self):
        self.near: dict[str, list] = {}

    def add(self, word: str, count: int, n: int, other: str) -> None:
        mine = self.near.get(word)
        if mine is None:
            self.near[word] = [count, n, other]
            return
        mine[0] += count
        if (-n, other) < (-mine[1], mine[2]):
            mine[1:] = n, other

    def bucket(self, members: list[tuple[str, int]]) -> None:
        """Words that are all one edit apart from each other: of a word's fellows only
        their number and the best one matter."""
        best = sorted(members, key=lambda m: (-m[1], m[0]))[:2]
        for word, _ in members:
            other = best[0] if best[0][0] != word else best[1]
            self.add(word, len(members) - 1, other[1], other[0])


def verify(short: list[tuple], longer: list[tuple]) -> Found:
    """All pairs of one key that are one edit apart inside its window, as numbers and
    best fellows. Rows: (word, n, a, b). Few words are compared in pairs, many by what
    is left of them without one position, which is linear in their number."""
    found = Found()
    window = max(b - a for _, _, a, b in short)
    if len(short) <= 2 * window + 1:
        for (u, n, a, b), (v, m, *_) in combinations(short, 2):
            e = _parting(u, v)
            if len(u) == len(v) and a <= e < b and u[e + 1 :] == v[e + 1 :]:
                found.add(u, 1, m, v)
                found.add(v, 1, n, u)
    else:
        buckets = defaultdict(list)
        for u, n, a, b in short:
            for e in range(a, b):
                buckets[e, u[:e] + u[e + 1 :]].append((u, n))
        for members in buckets.values():
            if len(members) > 1:
                found.bucket(members)
    if len(short) <= 2 * window + 1:
        for (u, n, a, b), (v, m, *_) in product(short, longer):
            e = _parting(u, v)
            if len(u) + 1 == len(v) and a <= min(e, len(u) - 1) < b and u[e:] == v[e + 1 :]:
                found.add(u, 1, m, v)
                found.add(v, 1, n, u)
    else:
        known = {u: (n, a, b) for u, n, a, b in short}
        for v, m, a, b in longer:
            last = len(v) - 1
            for e in range(a, b + (b == last)):
                if e == last or v[e] != v[e + 1]:  # the last of equal code points stands for all
                    u = v[:e] + v[e + 1 :]
                    if u in known:
                        found.add(u, 1, m, v)
                        found.add(v, 1, known[u][0], u)
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to (word, n_near, form_n, form) of each key's words."""
    key, short, longer, out = None, [], [], []

    def close():
        if short and len(short) + len(longer) > 1:
            out.extend((w, *x) for w, x in verify(short, longer).near.items())
        short.clear()
        longer.clear()

    def batch_of():
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "form_n", "form"])

    for batch in batches:
        for here, word, n, a, b, more in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "a", "b", "longer")), strict=True):
            if here != key:
                close()
                key = here
                if len(out) >= 10_000:
                    yield batch_of()
            (longer if more else short).append((word, n, a, b))
    close()
    yield batch_of()


def near_words(words: DataFrame, least: int = MIN_LENGTH, crowded: int = CROWDED) -> DataFrame:
    """(word, n_near, best) for each of ``words`` (word, n) that has near ones; ``best``
    is a struct (-n, word) of the near word of largest n, ties by code points."""
    found = None
    for rows in candidate_rows(words, least, crowded):
        dealt = rows.select("key", "word", "n", "a", "b", "longer").repartition("key").sortWithinPartitions("key")
        part = dealt.mapInArrow(_verified, "word string, n_near long, form_n long, form string")
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


# ---------------------------------------------------------------- forms and roots


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): chains are followed by doubling. A form is at
    least twice as frequent as its word, so a chain has at most 63 steps and there
    are at most 7 rounds."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        release(now)
        now = after
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = MIN_LENGTH, often: int = MIN_COUNT, mutated: int = MUTATED, crowded: int = CROWDED, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a word of ``docs``: word, form, root, n, n_near, form_n.

    Two words are near if one inserted, deleted or replaced code point makes one of
    the other. A word's form is its near word of largest n (ties: first in code-point
    order) if that is at least twice the word's own n, else null; its root is the last
    of the chain of forms, or the word itself. Null ids count as empty ones, null texts
    have no words, repeated rows count each, and of other columns nothing is read. A
    text's words are counted piece by piece, so that a task holds one text and
    ``HELD`` words, however long it is.
    """
    words = materialize(count_words(docs, least, often, mutated, id, text), "words")
    near = materialize(near_words(words, least, crowded), "near")
    judged = words.join(near, "word", "left")
    likely = -F.col("best.minus") >= 2 * F.col("n")
    judged = materialize(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.form")).alias("form"), F.when(likely, -F.col("best.minus")).alias("form_n")), "judged")
    roots = _roots(judged.where(F.col("form").isNotNull()))
    out = materialize(judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    release(words, near, judged)
    return out

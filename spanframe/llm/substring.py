"""Substring dedup with a compressed FM-index per shard.

A window is 13 consecutive words of one document. Each window has an anchor, the
word 5-gram of smallest hash inside it; equal windows have equal anchors. The
windows of one anchor place form a segment of words. Anchors only route: the
segments whose anchor also occurs in another document go to the shard of their
anchor, so that equal windows meet in one shard, and a shard's size follows the
repeated text only. Segments of an anchor that would overfill a shard are cut into
their windows, which are routed each by its own hash.

A shard indexes its distinct segments and streams the documents' segments through
backward search. That gives matching statistics: for every word the longest run of
words ending there that a segment of an earlier document holds, that is, whose
interval in the suffix array holds an earlier owner. Runs of 13 words and more are
reported as intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import give_back, hash_grams, hash_words, in_slices, join_sized, materialize, mix64, release

WORDS = 13
ANCHOR = 5
#: Words that a shard's index holds; it is cut between anchors.
BLOCK_WORDS = 300_000
#: Bytes kept of a word's hash in a segment.
PACKED = 6
#: Up to this many documents with removals their spans are broadcast.
BROADCAST_DOCS = 300_000
#: Ends the span of a text that an earlier document has whole.
ALL = (1 << 31) - 1
#: Stands for a null doc_id: later than every document.
LAST = (1 << 63) - 1


# ---------------------------------------------------------------- FM-index


class BitVector:
    """Packed bits in words of 64. Words of equal bits, which fill the runs that
    repeated text leaves in the transform, are kept as their kind only."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int32)
        mixed = (words != 0) & (words != ~np.uint64(0))
        # place among the mixed words, or -1 (all zero) and -2 (all one)
        self.place = np.where(mixed, np.cumsum(mixed) - 1, np.where(words == 0, -1, -2)).astype(np.int32)
        self.words = np.concatenate([words[mixed], [~np.uint64(0), np.uint64(0)]])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[self.place[word]] & mask).astype(np.int64)


class WaveletMatrix:
    """Rank over a sequence of symbols: one bit vector per symbol bit."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        left = symbols.astype(np.uint32)
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = ((left >> np.uint32(shift)) & np.uint32(1)).astype(bool)
            self.levels.append((np.uint32(shift), BitVector(bits), len(bits) - int(bits.sum())))
            left = np.concatenate([left[~bits], left[bits]])
        # where each symbol's run starts at the bottom
        self.starts = self._descend(np.arange(sigma, dtype=np.uint32), np.zeros(sigma, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, vector, zeros in self.levels:
            ones = vector.ones(at)
            at = np.where((symbols >> shift) & np.uint32(1), zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._descend(symbols, at) - self.starts[symbols]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` symbols or more."""
    rank, width = text.astype(np.int64), 1
    while True:
        after = np.concatenate([rank[width:], np.zeros(min(width, len(rank)), np.int64)]) if width < depth else None
        code = rank if after is None else rank * (rank.max(initial=0) + 1) + after
        order = np.argsort(code, kind="stable")
        if after is None:
            return order
        rank = np.empty(len(code), dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(code[order]) != 0)]) + 1
        width *= 2


class FMIndex:
    """Index of sequences of symbols 1..sigma-1, for patterns up to ``depth``.
    Sequences are joined by 0; suffixes are sorted as deep as patterns reach."""

    def __init__(self, sequences: list[np.ndarray], sigma: int, depth: int):
        lengths = np.array([len(s) + 1 for s in sequences])
        text = np.concatenate([np.append(s, 0) for s in sequences])
        order = sorted_suffixes(text, depth)
        self.source = np.repeat(np.arange(len(sequences), dtype=np.int32), lengths)[order]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.text, self.starts = text, np.cumsum(lengths) - lengths

    def intervals(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array intervals of the patterns text[p : p + length]. A search
        ends early once one suffix is left: the pattern itself."""
        symbol = self.text[places + length - 1]
        low, high = self.before[symbol].copy(), self.before[symbol + 1].copy()
        live = np.arange(len(places))
        for k in range(length - 2, -1, -1):
            live = live[high[live] - low[live] > 1]
            if not len(live):
                break
            symbol = self.text[places[live] + k]
            code = symbol.astype(np.uint32)
            low[live] = self.before[symbol] + self.bwt.rank(code, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(code, high[live])
        return low, high


    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns of [low, high) with a symbol before them."""
        code = symbol.astype(np.uint32)
        return self.before[symbol] + self.bwt.rank(code, low), self.before[symbol] + self.bwt.rank(code, high)

    def matching_statistics(self, patterns: list[np.ndarray], own: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """For every symbol of the ``patterns`` the length of the longest run ending
        there, inside its pattern, that a sequence of a smaller owner holds.
        ``own`` are the patterns' owners, ``owners`` the sequences'. All places
        step to the left together; one leaves where no smaller owner is left."""
        smallest = RangeMinima(owners[self.source])
        stream = np.concatenate(patterns)
        lengths = np.array([len(p) for p in patterns])
        room = np.arange(len(stream)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        mine = np.repeat(own, lengths)
        found = np.zeros(len(stream), dtype=np.int64)
        live = np.arange(len(stream))
        low, high = self.before[stream], self.before[stream + 1]
        n = 0
        while len(live):
            good = smallest.below(low, high, mine[live])
            live, low, high = live[good], low[good], high[good]
            n += 1
            found[live] = n
            more = room[live] >= n
            live = live[more]
            low, high = self.step(stream[live - n], low[more], high[more])
        return found


class RangeMinima:
    """Minima of runs of values, by a table of power-of-two runs."""

    def __init__(self, values: np.ndarray):
        self.names, ranks = np.unique(values, return_inverse=True)
        self.tables = [ranks.astype(np.int32)]
        while 1 << len(self.tables) <= len(values):
            last, k = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(last[:-k], last[k:]))

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether min(values[low:high]) < limit; no for empty runs."""
        limit = np.searchsorted(self.names, limit)
        span = np.frexp(high - low)[1] - 1
        out = np.zeros(len(low), dtype=bool)
        for k in np.unique(span[high > low]).tolist():
            here = np.flatnonzero((span == k) & (high > low))
            table = self.tables[k]
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k)]) < limit[here]
        return out


def repeated_intervals(segments: list[np.ndarray], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For every segment the intervals (begin, end inclusive) of at least ``length``
    words that a segment of a smaller owner holds; none lies in another."""
    names, codes = np.unique(np.concatenate(segments), return_inverse=True)
    sizes = np.array([len(s) for s in segments])
    parts = np.split(codes + 1, np.cumsum(sizes)[:-1])
    index = FMIndex(parts, len(names) + 1, int(sizes.max()))
    found = index.matching_statistics(parts, owners, owners)
    end = np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.append(found[1:] == found[:-1] + 1, False)  # the next run holds this one
    inside[np.cumsum(sizes) - 1] = False
    report = (found >= length) & ~inside
    pairs = np.stack([end - found + 1, end], axis=1)
    return [p[r] for p, r in zip(np.split(pairs, np.cumsum(sizes)[:-1]), np.split(report, np.cumsum(sizes)[:-1]))]


# ---------------------------------------------------------------- anchors


def anchor_segments(texts: list[bytes], length: int):
    """Of all windows of the texts, grouped by anchor place: text number, key,
    first window start, last window start (from the text's first word), and the
    word hashes with their bounds."""
    hashes, bounds = hash_words(texts)
    width = length - ANCHOR + 1
    n = len(hashes) - length + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none.view(np.uint64), none, none, hashes, bounds
    grams = hash_grams(hashes, ANCHOR)
    place = np.lib.stride_tricks.sliding_window_view(grams, width)[:n].argmin(axis=1) + np.arange(n)
    start = np.arange(n)
    text = np.searchsorted(bounds, start, side="right") - 1
    inside = start + length <= bounds[text + 1]
    start, text, place = start[inside], text[inside], place[inside]
    if not len(start):
        return start, start.view(np.uint64), start, start, hashes, bounds
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(start)]]) - 1
    return text[at], grams[place[at]], start[at] - bounds[text[at]], start[last] - bounds[text[at]], hashes, bounds


def _texts(column) -> list[bytes]:
    return [t.as_py() or b"" for t in column]


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Distinct (key, d) of documents (d, text)."""

    def run(batches):
        for batch in batches:
            for some in in_slices(list(zip(batch.column(0).to_pylist(), _texts(batch.column(1)))), lambda r: len(r[1])):
                text, key, *_ = anchor_segments([t for _, t in some], length)
                d = np.array([d for d, _ in some], dtype=np.int64)[text]
                pairs = np.unique(np.stack([d, key.view(np.int64)]), axis=1) if len(d) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(pairs[0])], ["key", "d"])

    return docs.select("d", "text").mapInArrow(run, "key long, d long")


def segments(docs: DataFrame, length: int) -> DataFrame:
    """Segments of documents (d, t, text, keys) whose anchors are in ``keys``:
    d, t, start, key, sid (a hash of the words), words (packed hashes)."""

    def run(batches):
        for batch in batches:
            d, t = (batch.column(i).to_pylist() for i in (0, 1))
            for some in in_slices(list(zip(d, t, _texts(batch.column(2)), batch.column(3))), lambda r: len(r[2])):
                text, key, first, last, hashes, bounds = anchor_segments([r[2] for r in some], length)
                blob = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED]).tobytes()
                mine = [r[3].values.to_numpy(zero_copy_only=False).view(np.uint64) for r in some]
                owner = np.repeat(np.arange(len(some), dtype=np.uint64), [len(m) for m in mine])
                tagged = mix64(np.concatenate(mine) + owner) if mine else np.zeros(0, np.uint64)
                chosen = np.flatnonzero(np.isin(mix64(key + text.astype(np.uint64)), tagged))
                begin = (bounds[text[chosen]] + first[chosen]) * PACKED
                end = (bounds[text[chosen]] + last[chosen] + length) * PACKED
                words = [blob[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                sid = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in words]
                rows = [some[i] for i in text[chosen].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(first[chosen].astype(np.int32)), pa.array(key[chosen].view(np.int64)), pa.array(sid, pa.int64()), pa.array(words, pa.binary())],
                    ["d", "t", "start", "key", "sid", "words"],
                )

    return docs.select("d", "t", "text", "keys").mapInArrow(run, "d long, t long, start int, key long, sid long, words binary")


SPANS = "array<struct<begin:int,end:int>>"


def search_shards(distinct: DataFrame, length: int) -> DataFrame:
    """key, sid, proof, first, spans of distinct segments (key, sid, words, first, last): the
    intervals of the first document's segment that earlier documents hold. Segments
    without any that only the first document has are left out."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def block(rows):
        if not rows:
            return
        packed = [np.frombuffer(r[2], dtype=np.uint8).reshape(-1, PACKED) for r in rows]
        wide = np.zeros((sum(map(len, packed)), 8), dtype=np.uint8)
        wide[:, :PACKED] = np.concatenate(packed)
        cuts = np.cumsum([len(p) for p in packed])[:-1]
        first = np.array([r[3] for r in rows], dtype=np.int64)
        found = repeated_intervals(np.split(wide.view("<u8").reshape(-1), cuts), first, length)
        hit = [(r[0], r[1], r[5], r[3], [{"begin": a, "end": b} for a, b in f.tolist()]) for r, f in zip(rows, found) if len(f) or r[3] < r[4]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind)
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hit], k) for i, k in enumerate(kinds)], ["key", "sid", "proof", "first", "spans"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held >= BLOCK_WORDS and row[0] != rows[-1][0]:
                    yield from block(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[2]) // PACKED
        yield from block(rows)
        give_back()

    lined = distinct.select("key", "sid", "words", "first", "last", proof()).repartition("key").sortWithinPartitions("key")
    return lined.mapInArrow(run, f"key long, sid long, proof long, first long, spans {SPANS}")


def proof() -> Column:
    """A second hash of a segment's words, beside its anchor and ``sid``: segments meet
    by 128 bits and more."""
    return F.xxhash64("words").alias("proof")


def meet(parts: DataFrame, owners: DataFrame) -> DataFrame:
    """Each segment (d, t, start, key, sid, words) with the first document and the spans
    found for it, as _n, first and spans."""
    n = F.expr(f"int(length(words) div {PACKED})").alias("_n")
    return parts.select("d", "t", "start", "key", "sid", proof(), n).join(owners, ["key", "sid", "proof"])


def cut_into_windows(parts: DataFrame, length: int) -> DataFrame:
    """Segments (d, t, start, key, sid, words) as their windows, each routed by its own hash."""
    window = lambda k: F.substring(F.col("words"), k * PACKED + 1, F.lit(length * PACKED))
    last = F.expr(f"length(words) div {PACKED} - {length}").cast("int")
    each = parts.select("d", "t", "start", F.posexplode(F.transform(F.sequence(F.lit(0), last), window)).alias("_k", "words"))
    return each.select("d", "t", (F.col("start") + F.col("_k")).alias("start"), F.xxhash64("words").alias("key"), F.xxhash64("words", F.lit(1)).alias("sid"), "words")


# ---------------------------------------------------------------- the operator


def later_copies(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (d, t) of texts (d, t, u) that an earlier document has as well, by both
    hashes, and the table that they were found by; both are materialized."""
    firsts = plain.groupBy("t", "u").agg(F.min("d").alias("_first"), F.max("d").alias("_last")).where("_first < _last").select("t", "u", "_first")
    firsts = materialize(firsts, "firsts")
    copies = join_sized(plain, firsts, ["t", "u"], "inner", BROADCAST_DOCS).where("d > _first").select("d", "t").distinct()
    return materialize(copies, "copies"), firsts


def repeated_spans(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """d, t, spans: the word intervals (begin, end inclusive, by begin) that windows
    of earlier documents cover, for each document (d, t, text) that has any.

    Equal texts (by their hash ``t`` and a second one over text and length) collapse
    into the first one's: all of a later copy is covered, and what the first has of
    earlier texts the search finds.
    """
    plain = materialize(docs.select("d", "t", F.xxhash64(F.octet_length("text"), "text").alias("u")), "texts")
    copies, firsts = later_copies(plain)
    single = join_sized(docs, copies, ["d", "t"], "left_anti", BROADCAST_DOCS)

    of_key = Window.partitionBy("key")
    shared = anchors(single, length).withColumn("_a", F.min("d").over(of_key)).withColumn("_b", F.max("d").over(of_key)).where("_a < _b")
    shared = shared.groupBy("d").agg(F.collect_list("key").alias("keys"))
    parts = made = materialize(segments(single.join(shared, "d"), length), "segments")

    distinct = lambda t: t.groupBy("key", "sid", "words").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    sizes = parts.groupBy("key", "sid").agg(F.max(F.length("words")).alias("_n")).groupBy("key").agg(F.sum("_n").alias("_bytes"))
    heavy = materialize(sizes.where(F.col("_bytes") > BLOCK_WORDS * PACKED).select("key"), "heavy")
    if not heavy.isEmpty():
        crowded = cut_into_windows(join_sized(parts, heavy, ["key"], "left_semi", BROADCAST_DOCS), length)
        parts = join_sized(parts, heavy, ["key"], "left_anti", BROADCAST_DOCS).unionByName(crowded)
    distinct = distinct(parts)
    owners = search_shards(distinct, length)
    # all of a segment that an earlier document has whole; of its first document what the search found
    hits = meet(parts, owners)
    whole = F.array(F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("_n") - 1).alias("end")))
    some = F.transform("spans", lambda x: F.struct((F.col("start") + x["begin"]).alias("begin"), (F.col("start") + x["end"]).alias("end")))
    hits = hits.select("d", "t", F.inline(F.when(F.col("d") > F.col("first"), whole).otherwise(some)))
    # overlapping intervals are one: a new one begins behind all ends before it
    in_text = Window.partitionBy("d", "t").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("d", "t").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("_new", F.coalesce(F.col("begin") > F.max("end").over(in_text) + 1, F.lit(True)).cast("int")).withColumn("_i", F.sum("_new").over(so_far))
    hits = hits.groupBy("d", "t", "_i").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = hits.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    spans = materialize(spans.unionByName(copies.select("d", "t", F.expr(f"array(struct(0 as begin, {ALL} as end))").alias("spans"))), "spans")
    release(made, plain, firsts, copies)
    return spans


def remove_repeats(docs: DataFrame, *, length: int = WORDS, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed,
    kept_sha256 and, if asked for, kept_text (kept words joined by one space).

    A word goes if a window of ``length`` words over it also starts in a document
    with a smaller doc_id; windows are judged on the input. Null and empty texts
    have no words. A null doc_id comes after all others, and such rows do not
    count as earlier for each other; neither do rows that repeat a doc_id. Empty
    tables give empty results. Other columns play no part.
    """
    t = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    t = t.withColumn("t", F.xxhash64("text"))
    spans = repeated_spans(t.select("d", "t", "text"), length)
    joined = join_sized(t, spans, ["d", "t"], "left", BROADCAST_DOCS).select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(i) for i in range(3))):
                words = text.as_py().split()
                kept, at = [], 0
                for span in (spans.as_py() or ()) if len(words) >= length else ():
                    kept += words[at : span["begin"]]
                    at = max(at, span["end"] + 1)
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((doc.as_py(), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined)[: len(kinds)])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.binary())][: 4 + with_text]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text
    done = joined.mapInArrow(run, schema)
    return done.withColumn("kept_text", F.col("kept_text").cast("string")) if with_text else done

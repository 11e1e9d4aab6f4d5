"""Exact n-gram Jaccard self-join with token-combination prefixes.

A document's set is the set of its word shingles, as 64-bit hashes. If two sets
x, y reach the similarity, x has at most e = |x| - ceil(s * |x|) tokens that y
lacks. Tokens are lined up rare before frequent, and a prefix of them is indexed:
rare tokens singly, frequent ones in pairs. The prefix ends once its rare tokens
and its frequent tokens beyond the first of their class number e + 1: the e
missing tokens then cannot break every key, so similar sets share a key. Small
sets have one class, larger ones a class for about every token that may be
missing, so that the pairs stay in proportion to the set.

Frequency only shapes the keys, never the result: a token is frequent if its
cell of a fixed table of counters, summed over all documents, stands out.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import give_back, hash_grams, hash_words, in_slices, join_sized, materialize, mix64, release
from spanframe.llm.components import connected_components

WORDS, PERCENT = 3, 90
#: Counters of the frequency table, and how many standard deviations stand out.
COUNTER_BITS = 20
STAND_OUT = 5.0
#: Tasks whose counters are summed first.
LANE = 256
#: A sketch counts tokens by hash cell, in at least this many cells of about
#: CELL_LOAD tokens; it bounds an overlap from above.
CELLS, CELL_LOAD = 64, 4
#: Lists that a set must share with their first set to be compared with it ahead
#: of the rest, from this size on; the comparison of whole lists needs none.
SHARED_LISTS, SHARED_FROM = 2, 20
#: Members of a list that are compared as one block.
BLOCK = 4096
#: Tokens of the texts that are verified as one block.
BLOCK_TOKENS = 500_000
#: Partners that are verified in one step.
STEP = 32
#: Members that one copy of a text is compared with.
GROUP = 512
#: Tables up to this many rows are broadcast to fetch texts or labels, else joined by shuffle.
BROADCAST_PAIRS = 400_000

_SINGLE, _PAIR = (np.uint64(x) for x in (0x2E4C6A88, 0x9D8C7B6A))


# ---------------------------------------------------------------- inside tasks


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than n words are one shingle."""
    if len(words) == 0:
        return words
    return np.unique(hash_grams(words, min(n, len(words))) ^ np.uint64(min(n, len(words))))


def shingle_sets(rows: list, n: int):
    """(row, set) for rows whose last field is the text in bytes."""
    for some in in_slices(rows, lambda r: len(r[-1])):
        hashes, bounds = hash_words([r[-1] for r in some], lower=True)
        for i, row in enumerate(some):
            yield row, shingles(hashes[bounds[i] : bounds[i + 1]], n)


def missing(n: int, percent: int) -> int:
    """Tokens of a set of n that a similar set may lack."""
    return n - -(-n * percent // 100)


def classes(level: int, percent: int) -> int:
    """Classes of frequent tokens when sets of 2**level tokens and more (up to
    twice as many) meet their partners; 0 if these are too small for pairs."""
    least = (1 << level) - missing(1 << level, percent)
    return min(least - missing(least, percent) - 1, max(1, (1 << level) * (100 - percent) // 100))


def keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set (see the module's text); ``frequent`` flags its tokens."""
    n = len(tokens)
    rare, common = tokens[~frequent], tokens[frequent]
    need = missing(n, percent) + 1
    out = [mix64(rare[:need] ^ _SINGLE)]
    need -= len(out[0])
    if need > 0:  # for every level that its partners' sizes reach
        for level in range((n - missing(n, percent)).bit_length() - 1, (n * 100 // percent).bit_length()):
            if not (c := classes(level, percent)):
                out.append(mix64(common[:need] ^ _SINGLE))
                continue
            klass = common % np.uint64(c)
            order = np.argsort(klass, kind="stable")
            more = np.zeros(len(common), dtype=bool)  # not the first of its class
            more[order[1:]] = klass[order[1:]] == klass[order[:-1]]
            cut = int(np.searchsorted(np.cumsum(more), need)) + 1
            order = order[order < cut]
            members, klass = common[order], klass[order]
            for gap in range(1, len(members)):
                if not (same := klass[gap:] == klass[:-gap]).any():
                    break
                out.append(mix64((members[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + members[gap:][same]) ^ _PAIR))
    return np.unique(np.concatenate(out))


def sketch(tokens: np.ndarray) -> bytes:
    """Tokens by the low bits of their hashes, a byte a cell; a power of two of
    cells, so that a longer sketch folds onto a shorter one."""
    cells = CELLS
    while cells * CELL_LOAD < len(tokens):
        cells *= 2
    while (counts := np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells)).max() > 255:
        cells *= 2
    return counts.astype(np.uint8).tobytes()


def folded(sketches: list[np.ndarray], cells: int) -> np.ndarray:
    return np.array([s.reshape(-1, cells).sum(axis=0, dtype=np.int32) for s in sketches])


def linked(common, total, percent: int):
    """Whether ``common`` tokens of ``total`` in the two sets together suffice."""
    return 100 * common >= percent * (total - common)


# ---------------------------------------------------------------- steps


def _text_rows(batch, width: int) -> list:
    return [(*(batch.column(i)[k].as_py() for i in range(width - 1)), batch.column(width - 1)[k].as_py() or b"") for k in range(batch.num_rows)]


def frequent_cells(docs: DataFrame, n: int) -> np.ndarray:
    """Which cells of the counter table stand out, as booleans (2**COUNTER_BITS)."""
    size, parts = 1 << COUNTER_BITS, 64
    step = size // parts

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for some in in_slices([t.as_py() or b"" for t in batch.column(0)], len):
                hashes, bounds = hash_words(some, lower=True)
                grams = hash_grams(hashes, n) ^ np.uint64(n)
                if len(grams):  # not those that reach into the next text
                    inside = np.ones(len(hashes), dtype=bool)
                    ends = bounds[1:]
                    for k in range(1, n):
                        inside[np.maximum(ends[ends > bounds[:-1]] - k, 0)] = False
                    total += np.bincount((grams[inside[: len(grams)]] >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=size)
        blobs = []
        for i in range(parts):
            np.savez_compressed(f := io.BytesIO(), c=total[i * step : (i + 1) * step].astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.int64))
            blobs.append(f.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts")):
                with np.load(io.BytesIO(blob.as_py())) as f:
                    sums[part] = sums.get(part, 0) + f["c"].astype(np.int64)
        blobs = []
        for counts in sums.values():
            np.savez_compressed(f := io.BytesIO(), c=counts)
            blobs.append(f.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    kind = "part int, counts binary"
    parts_of = docs.select(F.col("text").cast("binary")).mapInArrow(count, kind)
    # sums of LANE tasks' tables, then of these; a task holds one sum a part
    lanes = parts_of.withColumn("_lane", F.expr(f"spark_partition_id() div {LANE}")).repartition("part", "_lane").select("part", "counts").mapInArrow(add, kind)
    rows = lanes.repartition(parts, "part").mapInArrow(add, kind).collect()  # 8 MB at any size
    total = np.zeros(size, dtype=np.int64)
    for row in rows:
        with np.load(io.BytesIO(row.counts)) as f:
            total[row.part * step : (row.part + 1) * step] += f["c"]
    mean = np.median(total)
    return total > mean + STAND_OUT * np.sqrt(mean) + STAND_OUT


def index_sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), keys, sketch."""
    cells = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent_cells(docs, n)))

    def run(batches):
        flags = np.unpackbits(cells.value).view(bool)
        for batch in batches:
            rows = []
            for (doc, _), tokens in shingle_sets(_text_rows(batch, 2), n):
                if len(tokens):
                    f1, f2 = np.bitwise_xor.reduce(mix64(tokens)), mix64(tokens ^ _PAIR).sum(dtype=np.uint64)
                    k = keys(tokens, flags[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], percent).view(np.int64)
                    rows.append((doc, len(tokens), int(f1.astype(np.int64)), int(f2.astype(np.int64)), k, sketch(tokens)))
                else:
                    rows.append((doc, 0, 0, 0, np.zeros(0, np.int64), b""))
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
        give_back()

    def _batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_shingles", "f1", "f2", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sketch binary")


def verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the materialized ``pairs`` (a, b) whose texts reach the similarity.

    Each text b goes once to each a that it is compared with; a is copied for
    every GROUP of its partners, so no a is bound to one task.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("_parts"))
    dealt = materialize(pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_parts")).alias("part"), "b"), "pairs")
    wanted = dealt.select("a", "part", "b", F.col("b").alias("doc_id")).union(dealt.select("a", "part", F.lit(None).cast("long"), F.col("a")).distinct())
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = join_sized(texts, materialize(wanted, "wanted"), ["doc_id"], "inner", 2 * BROADCAST_PAIRS).select("a", "part", "b", "text")

    def run(batches):
        key, left = None, []
        for batch in batches:
            found = []
            for (a, part, b, _), tokens in shingle_sets(_text_rows(batch, 4), n):
                if (a, part) != key:
                    key, left = (a, part), []
                if b is None:
                    left.append(tokens)
                elif any(linked(len(np.intersect1d(x, tokens, assume_unique=True)), len(x) + len(tokens), percent) for x in left):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        give_back()

    lined = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return lined.mapInArrow(run, "a long, b long")


class _Block:
    """Members of a list or group, lined up by size, with a label each: the pairs
    of different labels whose sizes and sketches leave the similarity possible."""

    def __init__(self, labels, sizes, blocks, sketches: list[np.ndarray], percent: int):
        self.labels = np.unique(labels, return_inverse=True)[1].astype(np.int64)
        self.sizes, self.blocks, self.percent = sizes, blocks, percent
        self.one = blocks.min() == blocks.max()
        self.lengths = np.array([len(x) for x in sketches])
        self.tables = {int(c): folded([x for x in sketches if len(x) >= c], int(c)) for c in np.unique(self.lengths)}
        self.rank = {c: np.cumsum(self.lengths >= c) - 1 for c in self.tables}

    def partners(self, i: int, labels: np.ndarray) -> np.ndarray:
        """Later members that may be similar to i, of other ``labels``, best first."""
        last = int(np.searchsorted(self.sizes, self.sizes[i] * 100 // self.percent, side="right"))
        j = np.arange(i + 1, last)
        j = j[(labels[j] != labels[i]) & (self.one | (self.blocks[j] != self.blocks[i]))]
        found, bounds = [], []
        lengths = np.minimum(self.lengths[i], self.lengths[j])
        for cells in np.unique(lengths).tolist():
            some = j[lengths == cells]
            table, at = self.tables[cells], self.rank[cells]
            common, total = np.minimum(table[at[i]], table[at[some]]).sum(axis=1), self.sizes[i] + self.sizes[some]
            passed = linked(common, total, self.percent)
            found.append(some[passed])
            bounds.append((common / total)[passed])
        return np.concatenate(found)[np.argsort(-np.concatenate(bounds), kind="stable")] if found else j


def _merge(labels: np.ndarray, i: int, others: np.ndarray) -> None:
    """Give the members that share a label with ``others`` that of i."""
    labels[np.isin(labels, labels[others])] = labels[i]


def candidate_groups(members: DataFrame, percent: int) -> DataFrame:
    """Groups of members (key, low, high, id, comp, n, block, sketch) that chains
    of possible partners from other components connect inside a block: g (a hash
    of the ids), members (id, comp, block), blocks (of BLOCK_TOKENS). One row a
    group at most, so rows grow with members and not with pairs."""

    def run(batches):
        for rows in _runs(batches, 3):
            found = groups([r[3:] for r in rows])
            if found:
                kind = pa.list_(pa.struct([("id", pa.int64()), ("comp", pa.int64()), ("block", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], kind), pa.array([f[2] for f in found], pa.int32())], ["g", "members", "blocks"])
        give_back()

    def groups(rows):
        ids, comps, sizes, blocks = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(4))
        block = _Block(comps, sizes, blocks, [np.frombuffer(r[4], dtype=np.uint8) for r in rows], percent)
        if len(np.unique(block.labels)) < 2:
            return []
        labels = block.labels.copy()
        joined = np.zeros(len(rows), dtype=bool)
        for i in range(len(rows) - 1):
            j = block.partners(i, block.labels)
            if len(j):
                joined[i] = joined[j] = True
                _merge(labels, i, j)
        out = []
        chosen = np.flatnonzero(joined)
        chosen = chosen[np.argsort(labels[chosen], kind="stable")]
        for mine in np.split(chosen, np.flatnonzero(np.diff(labels[chosen])) + 1) if len(chosen) else ():
            part = (np.cumsum(sizes[mine]) // BLOCK_TOKENS).astype(int)
            part = np.unique(part, return_inverse=True)[1]
            g = xxhash.xxh64_intdigest(np.sort(ids[mine]).tobytes()) - (1 << 63)
            out.append((g, [{"id": int(x), "comp": int(c), "block": int(k)} for x, c, k in zip(ids[mine], comps[mine], part)], int(part.max()) + 1))
        return out

    return members.mapInArrow(run, "g long, members array<struct<id:long,comp:long,block:int>>, blocks int")


def _runs(batches, width: int):
    """Runs of rows that are equal in their first ``width`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:width] != key:
                if rows:
                    yield rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield rows


def verified_links(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between members (g, low, high, id, comp, block, text) of a
    group whose sets reach the similarity: enough of them to connect what they
    connect, fewer than members. Compares sets inside the task, every pair of
    different components that the sketches leave open."""

    def run(batches):
        for rows in _runs(batches, 3):
            found = links(rows)
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        give_back()

    def links(rows):
        sets = [(r, t) for r, t in shingle_sets([(*r[:-1], r[-1] or b"") for r in rows], n) if len(t)]
        if len(sets) < 2:
            return []
        sets.sort(key=lambda x: len(x[1]))
        ids, comps, blocks = (np.array([r[i] for r, _ in sets], dtype=np.int64) for i in (3, 4, 5))
        tokens = [t for _, t in sets]
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        block = _Block(comps, sizes, blocks, [np.frombuffer(sketch(t), dtype=np.uint8) for t in tokens], percent)
        labels, found = block.labels.copy(), []
        for i in range(len(sets) - 1):
            j = block.partners(i, labels)
            while len(j):
                some, j = j[:STEP], j[STEP:]
                every = np.concatenate([tokens[k] for k in some])
                at = np.searchsorted(tokens[i], every)
                at[at == len(tokens[i])] = 0
                ends = np.cumsum(sizes[some])
                common = np.diff(np.concatenate([[0], np.cumsum(tokens[i][at] == every)[ends - 1]]))
                some = some[linked(common, sizes[i] + sizes[some], percent)]
                for k in some:
                    if labels[k] != labels[i]:
                        found.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
                        _merge(labels, i, np.array([k]))
                j = j[labels[j] != labels[i]]
        return found

    return texts.mapInArrow(run, "a long, b long")


def _pairs_of_blocks(t: DataFrame, block: str, blocks) -> DataFrame:
    """Rows once for every block, as low and high: each pair of blocks meets."""
    t = t.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks).cast("int") - 1 if isinstance(blocks, int) else (blocks - 1).cast("int"))))
    return t.withColumn("low", F.least(block, "_other")).withColumn("high", F.greatest(block, "_other")).drop("_other")


def jaccard_components(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of characters other than ASCII white space, A-Z folded; a
    text's set holds its ``words``-word shingles, or with fewer words all of them
    as one. Texts link if 100 * |x & y| >= ``percent`` * |x | y|; component_id is
    the smallest doc_id reachable.

    1. Equal sets collapse into one, named by their smallest doc_id.
    2. Every set is compared with the first set of the lists that it shares most
       keys with.
    3. Lists that still span several components have their members compared by
       sketches, block by block; members of different components that may be
       similar form groups. A group's sets are compared inside a task, and only
       links that join what was apart come out. A pair inside one component
       changes nothing; no pair between components is left out.

    Nulls and empty texts have no shingles and link with nothing; a null doc_id
    links with nothing and has a null component. Rows that repeat a doc_id are
    one document with several texts, any of which can link. Empty tables give
    empty results. Other columns play no part.
    """
    f = ["f1", "f2", "n_shingles"]
    sets = materialize(index_sets(docs, words, percent), "sets")
    named = sets.where("n_shingles > 0 and doc_id is not null")
    firsts = named.groupBy(*f).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    firsts = materialize(firsts, "firsts")
    rows = join_sized(named, firsts, f, "left", BROADCAST_PAIRS).withColumn("id", F.coalesce("id", "doc_id"))
    ones = rows.where("doc_id = id").select("id", F.col("n_shingles").alias("n"), "keys", "sketch")
    # a doc_id whose rows have several sets joins them
    several = rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_z"), F.collect_set("id").alias("_ids")).where("a < _z").select("a", F.explode("_ids").alias("b"))

    in_list = Window.partitionBy("key")
    lists = ones.select(F.explode("keys").alias("key"), "id", "n")
    # a row whose neighbours by size are too small or too large has no partner in its list
    by_size = in_list.orderBy("n", "id")
    fits = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.lead("n").over(by_size) * percent <= F.col("n") * 100)
    lists = lists.withColumn("_fits", fits).where("_fits").drop("_fits")
    lists = lists.withColumn("_first", F.min(F.struct("id", "n")).over(in_list)).withColumn("_last", F.max("id").over(in_list))
    lists = materialize(lists.where("_first.id < _last").select("key", "id", "n", F.col("_first.id").alias("a"), F.col("_first.n").alias("_an")), "lists")

    sized = lists.where((F.least("n", "_an") * 100 >= F.greatest("n", "_an") * percent) & (F.col("a") < F.col("id"))).select("a", F.col("id").alias("b"), "n")
    shared = sized.repartition("b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"), F.max("n").alias("_size")).where((F.col("_n") >= SHARED_LISTS) | (F.col("_size") < SHARED_FROM))
    best = shared.groupBy("b").agg(F.max(F.struct("_n", (-F.col("a")).alias("a"))).alias("_m")).select((-F.col("_m.a")).alias("a"), "b")
    best = materialize(best, "best")
    links = materialize(several.union(verify(best, docs, words, percent)), "links")
    comps = materialize(connected_components(links), "components")

    spread = join_sized(lists.select("key", "id", "n"), comps, ["id"], "left", BROADCAST_PAIRS).withColumn("comp", F.coalesce("component", "id"))
    whole = lambda c: c.over(in_list)
    spread = spread.withColumns({
        "_split": whole(F.min("comp")) < whole(F.max("comp")),
        "size": whole(F.count(F.lit(1))),
        "at": F.row_number().over(by_size) - 1,
        # many keys have the same list: one of them will do
        "list": F.xxhash64(whole(F.count(F.lit(1))), whole(F.min("id")), whole(F.max("id")), whole(F.bit_xor(F.xxhash64("id"))), whole(F.bit_xor(F.xxhash64("id", F.lit(1))))),
    })
    spread = materialize(spread.where("_split").select("list", "id", "comp", "at", "size").distinct(), "spread")
    members = spread.join(ones.select("id", "n", "sketch"), "id")
    members = members.withColumn("block", F.expr(f"at div {BLOCK}").cast("int")).withColumn("blocks", F.expr(f"(size - 1) div {BLOCK} + 1"))
    members = _pairs_of_blocks(members, "block", F.col("blocks")).select("list", "low", "high", "id", "comp", "n", "block", "sketch")
    lined = members.repartition("list", "low", "high").sortWithinPartitions("list", "low", "high", "n", "id")
    groups = materialize(candidate_groups(lined, percent).dropDuplicates(["g"]), "groups")

    wanted = groups.select("g", "blocks", F.explode("members").alias("_m")).select("g", "blocks", "_m.id", "_m.comp", "_m.block")
    wanted = materialize(_pairs_of_blocks(wanted, "block", F.col("blocks")).select("g", "low", "high", F.col("id").alias("doc_id"), "comp", "block"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    texts = join_sized(texts, wanted, ["doc_id"], "inner", 2 * BROADCAST_PAIRS).select("g", "low", "high", F.col("doc_id").alias("id"), "comp", "block", "text")
    dealt = texts.repartition("g", "low", "high").sortWithinPartitions("g", "low", "high")
    more = verified_links(dealt, words, percent)
    links = materialize(more.union(comps.select(F.col("component").alias("a"), F.col("id").alias("b"))), "links")
    comps = materialize(connected_components(links), "components")
    release(lists, best, spread, groups, wanted, links)

    found = join_sized(rows.select("doc_id", "id", *f), comps, ["id"], "left", BROADCAST_PAIRS)
    out = found.select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.union(sets.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", "doc_id"))


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest
    doc_id. Of rows that repeat its doc_id one stays; rows without a doc_id stay."""
    comps = materialize(jaccard_components(docs.select("doc_id", "text"), **options), "components")
    gone = materialize(comps.where("doc_id is not null and doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = join_sized(docs, gone, ["doc_id"], "left_anti", BROADCAST_PAIRS)
    again = materialize(comps.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    once = join_sized(kept, again, ["doc_id"], "left_semi", BROADCAST_PAIRS).dropDuplicates(["doc_id"])
    return join_sized(kept, again, ["doc_id"], "left_anti", BROADCAST_PAIRS).unionByName(once)

"""Prefix tries of conversations: which turns are shared from the start on.

A node is a distinct sequence of first turns; its key is the XOR of a 120-bit hash of
each turn and its position, so that all prefixes of a conversation come out of one
running XOR, and a node's parent is its key without its last turn. Nodes are counted
by one aggregation that combines before it shuffles, so that thousands of equal
conversations are one path. Nodes are then dealt by the digest of their first turn,
and inside a task pointer dictionaries make tries of them, which an iterative
postorder sums up. A first-turn subtrie with more than ``MOST_NODES`` nodes is dealt
again by its next turn, and so on, and what was its top is summed from its children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import hex_number, materialize, ranked, release, word_count

#: Nodes of a subtrie that one task builds.
MOST_NODES = 8192
#: Turns that are ranked or summed inside one window; ids that are joined to one string.
CELL, CHUNK = 4096, 512

_KEY = ["depth", "p1", "p2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- turns


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos from 1, d1, d2, words): a conversation's turns in order of ``turn``,
    null first; ties fall by the turn's digest. Texts become digests of 120 bits."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    t = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.inline(F.array(F.struct(digest.alias("digest")))), word_count(said).alias("words"),
    )
    t = t.select("conv_id", "turn", hex_number(F.col("digest"), 1, 15).alias("d1"), hex_number(F.col("digest"), 17, 15).alias("d2"), "words")
    t = t.withColumn("cell", F.coalesce(F.floor(F.col("turn") / CELL), F.lit(-(1 << 53))))
    order = [F.col("turn").asc_nulls_first(), "d1", "d2"]
    return ranked(materialize(t, "turns"), ["conv_id"], "cell", order, "pos").select("conv_id", "pos", "d1", "d2", "words")


def forked(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: of conversation c the
    first h = crc32(c) % ``most`` turns come from conversation c - c % ``family`` (all it
    has if fewer, none if there is none), and its own first h go. Returns the turns,
    and (conv_id, n_turns) for every conversation, turnless ones too."""
    c = F.col("conv_id")
    h = F.when(c % family == 0, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % most)
    ids = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", (c - c % family).alias("giver"), h.alias("h"))
    ids = materialize(ids, "conversations")
    giver = ids.select(F.col("conv_id").alias("giver"), F.col("n").alias("has"))
    ids = ids.join(giver, "giver", "left").withColumn("k", F.least("h", F.coalesce("has", F.lit(0))))
    ids = materialize(ids.withColumn("n_turns", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    own = turns.join(ids.select("conv_id", "h", "k"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "d1", "d2", "words")
    first = turns.where(F.col("pos") < most).where(c % family == 0).withColumnRenamed("conv_id", "giver")
    given = ids.where("k > 0").select("conv_id", "giver", "k").join(first, "giver").where("pos <= k").select("conv_id", "pos", "d1", "d2", "words")
    return own.unionByName(given), ids.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn (conv_id, depth, words) with the key p1, p2 of the prefix that it ends,
    its parent's q1, q2 and its first turn's f1, f2. Windows hold ``CELL`` turns."""
    own = F.md5(F.concat_ws(":", "d1", "d2", "pos").cast("binary"))
    t = turns.select("conv_id", F.col("pos").alias("depth"), "words", F.inline(F.array(F.struct(own.alias("own")))))
    t = t.select("conv_id", "depth", "words", hex_number(F.col("own"), 1, 15).alias("h1"), hex_number(F.col("own"), 17, 15).alias("h2"), F.expr(f"depth div {CELL}").alias("cell"))
    cells = t.groupBy("conv_id", "cell").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.min_by(F.struct("h1", "h2"), "depth").alias("first"))
    along = Window.partitionBy("conv_id").orderBy("cell")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.bit_xor(x).over(earlier), F.lit(0))
    cells = cells.select("conv_id", "cell", before("b1").alias("b1"), before("b2").alias("b2"), F.first("first").over(along).alias("first"))
    inside = Window.partitionBy("conv_id", "cell").orderBy("depth")
    t = t.withColumns({"x1": F.bit_xor("h1").over(inside), "x2": F.bit_xor("h2").over(inside)}).join(cells, ["conv_id", "cell"])
    p1, p2 = F.col("x1").bitwiseXOR(F.col("b1")), F.col("x2").bitwiseXOR(F.col("b2"))
    return t.select(
        "conv_id", "depth", "words", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("h1")).alias("q1"), p2.bitwiseXOR(F.col("h2")).alias("q2"),
        F.col("first.h1").alias("f1"), F.col("first.h2").alias("f2"),
    )


# ---------------------------------------------------------------- tries

_SUMS = "depth long, p1 long, p2 long, q1 long, q2 long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def build_tries(nodes: pd.DataFrame) -> pd.DataFrame:
    """Whole subtries (p1, p2, q1, q2, own and more) with the sums of each node's
    subtree. A node whose parent is not among ``nodes`` is a top."""
    at = {key: i for i, key in enumerate(zip(nodes.p1, nodes.p2, strict=True))}
    parents = [at.get(key, -1) for key in zip(nodes.q1, nodes.q2, strict=True)]
    below: dict[int, list[int]] = {}
    for i, parent in enumerate(parents):
        below.setdefault(parent, []).append(i)
    leaves, saved, ids = [0] * len(parents), nodes.own.tolist(), nodes.conv_id.tolist()
    stack = [(top, False) for top in below.get(-1, [])]
    while stack:
        i, done = stack.pop()
        children = below.get(i, [])
        if not children:
            leaves[i] = 1
        elif done:
            leaves[i] = sum(leaves[c] for c in children)
            saved[i] += sum(saved[c] for c in children)
        else:
            stack.append((i, True))
            stack += [(c, False) for c in children]
    out = nodes[["depth", "p1", "p2", "q1", "q2", "conv_id", "n_convs"]].copy()
    out["parent_conv_id"] = pd.array([None if p < 0 else ids[p] for p in parents], dtype="Int64")
    out["n_children"] = [len(below.get(i, ())) for i in range(len(parents))]
    out["n_leaves"], out["saved_tokens"] = leaves, saved
    return out


def _small(nodes: DataFrame, total: int) -> DataFrame:
    """Subtries of at most ``MOST_NODES`` nodes, dealt by their key g1, g2."""
    buckets = max(total // MOST_NODES, 3 * nodes.sparkSession.sparkContext.defaultParallelism)
    return nodes.groupBy(F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)).alias("bucket")).applyInPandas(build_tries, _SUMS)


def _chains(nodes: DataFrame) -> DataFrame:
    """Subtries of one path, however long: sums from each node down to the end."""
    t = nodes.withColumn("cell", F.expr(f"depth div {CELL}"))
    cells = t.groupBy("g1", "g2", "cell").agg(F.sum("own").alias("more"))
    later = Window.partitionBy("g1", "g2").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("g1", "g2", "cell", F.coalesce(F.sum("more").over(later), F.lit(0)).alias("more"))
    inside = Window.partitionBy("g1", "g2", "cell").orderBy(F.col("depth").desc())
    t = t.withColumn("down", F.sum("own").over(inside)).join(cells, ["g1", "g2", "cell"])
    # the parent in the path is the node one higher; its smallest member is known by its key
    above = t.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    t = t.join(above, ["depth", "q1", "q2"], "left")
    return t.select(*_KEY, "q1", "q2", "conv_id", "n_convs", "parent_conv_id", F.when(F.col("leaf"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (F.col("down") + F.col("more")).alias("saved_tokens"))


def _summed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """All ``nodes`` (without the root) with their sums: _SUMS; parent_conv_id is null at
    depth 1. Rounds go on while subtries are too large; each deals those by one turn
    more, so there are as many as turns that too large subtries share, save that a
    subtrie of one path is summed as it is."""
    nodes = nodes.withColumns({"g1": F.col("f1"), "g2": F.col("f2")})
    total, k, tops, done, held = nodes.count(), 1, [], [], []
    now = nodes
    while True:
        sizes = now.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("size"), F.count_if("leaf").alias("leaves"))
        large = materialize(sizes.where(F.col("size") > MOST_NODES).select("g1", "g2", (F.col("leaves") == 1).alias("chain")), "large-tries")
        if large.isEmpty():
            release(large)
            done.append(_small(now, total))
            break
        marked = materialize(now.join(large, ["g1", "g2"], "left"), "tries")
        release(large)
        held.append(marked)
        done.append(_small(marked.where("chain is null").drop("chain"), total))
        done.append(_chains(marked.where("chain").drop("chain")))
        tops.append(marked.where("not chain").where(F.col("depth") == k))
        k += 1
        keys = rows.where(F.col("depth") == k).select("conv_id", F.col("p1").alias("g1"), F.col("p2").alias("g2"))
        now = materialize(marked.where("not chain").where(F.col("depth") >= k).drop("g1", "g2", "chain").join(keys, "conv_id"), "tries")
        held.append(now)
    sums = materialize(_union(done), "summed")
    for k, top in reversed(list(enumerate(tops, 1))):
        children = sums.where(F.col("depth") == k + 1).groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        children = children.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        known = top.join(children, _KEY).select(*_KEY, "q1", "q2", "conv_id", "n_convs", F.lit(None).cast("long").alias("parent_conv_id"), "n_children", "n_leaves", (F.col("own") + F.col("below")).alias("saved_tokens"))
        # the children of this top learn its smallest member
        mine = top.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
        rest = sums.join(mine, ["depth", "q1", "q2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).drop("above")
        after = materialize(rest.unionByName(known), "summed")
        release(sums)
        sums = after
    release(*held)
    return sums


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------- ends


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, p1, p2, ids) sorted by node and chunk: one hash a node."""
    key, digest, out = None, None, []
    made = lambda: pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(),) * 3 + (pa.string(),))], names=[*_KEY, "ends_sha256"])
    for batch in batches:
        for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
            if here != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield made()
        out = []
    if key is not None:
        out.append((*key, digest.hexdigest()))
    yield made()


def _ends(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2), one row a conversation, to a hash for each node of the
    ids that end there, ascending. Ids are joined by ``CHUNK`` before they meet, so a
    node at which a third of all conversations end sends few rows to its task, which
    streams them."""
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("chunk")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    chunks = ends.groupBy(*_KEY, chunk).agg(ids)
    dealt = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "ids")
    return dealt.mapInArrow(_hash_chunks, "depth long, p1 long, p2 long, ends_sha256 string")


# ---------------------------------------------------------------- the operator


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` (conv_id, pos from 1 without gaps, d1, d2, words) are those of
    ``ordered_turns``, ``ids`` has (conv_id, n_turns) once for every conversation. The
    root, of depth 0, has no text and no parent; without conversations there are
    no nodes. Conversations without id take no part, null roles and texts are empty,
    repeated turns are turns each. A conversation of any number of turns is dealt
    over tasks; texts are read once and never shuffled.
    """
    rows = materialize(prefixes(turns), "prefixes")
    nodes = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in ("conv_id", "q1", "q2", "f1", "f2", "words")))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    inner = rows.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.lit(False).alias("leaf")).distinct()
    nodes = materialize(nodes.join(inner, _KEY, "left").withColumn("leaf", F.coalesce("leaf", F.lit(True))), "nodes")
    sums = _summed(rows, nodes)
    everyone = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    least = everyone.first()
    first = sums.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    root = first.select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), _long(least and least.conv_id).alias("conv_id"), _long(least and least.n_convs).alias("n_convs"),
        _long(None).alias("parent_conv_id"), "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens",
    ).where("n_convs is not null")
    parent = F.when(F.col("depth") == 1, _long(least and least.conv_id)).otherwise(F.col("parent_conv_id"))
    every = sums.drop("q1", "q2").withColumn("parent_conv_id", parent).unionByName(root)
    last = rows.join(ids.where("n_turns > 0").select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select("conv_id", *_KEY)
    ends = _ends(last.unionByName(ids.where("n_turns = 0").select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"))))
    out = every.join(ends, _KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    out = materialize(out, "trie")
    release(rows, nodes, sums)
    return out


def _long(value) -> Column:
    return F.lit(value).cast("long")

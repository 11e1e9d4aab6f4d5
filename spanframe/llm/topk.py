"""Exact top-k search by inner product, pruned by segment statistics.

A vector is cut into segments of equal length; a segment is described by its mean
and its deviation (the norm of what is left without the mean). By Cauchy and
Schwarz the inner product of two segments is at most ``length * mean * mean +
deviation * deviation``, which is the usual lower bound of their distance, solved
for the product. Coarse levels (long segments) bound every pair first, finer ones
only what they leave, and exact products are made for the survivors. A pair goes
only if its bound is below the k-th best score that its query already has, so the
result is exact.

Rows travel as packs of ``PACK`` vectors. Queries are dealt to T tiles and
candidates to S tiles, and every cell (s, t) of that grid is a task of its own: it
holds the queries of t and streams the candidates of s. Equal vectors, however
many, lie in many tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm.common import materialize, release

#: Lengths of the segments, coarse to fine.
SEGMENTS = (64, 16, 4)
#: Vectors a row; queries that a task holds; candidates that a task streams.
PACK, TILE_QUERIES, TILE_ROWS = 32, 1 << 15, 1 << 18
#: Queries and candidates that are compared at once.
QUERY_CHUNK, ROW_CHUNK = 512, 2048
#: Above this share of open pairs the next level is cheaper for all pairs.
DENSE = 0.1
#: Components from here on are compared without bounds.
HUGE = 1e100

_LEAST, _MOST = -(2**63), 2**63 - 1
_PACKS = "dim int, n int, ids binary, hashes binary, vectors binary"


# ---------------------------------------------------------------- packs


def _packed(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector, hash) to packs of quantized vectors of one length."""
    for batch in batches:
        batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
        if not batch.num_rows:
            continue
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            flat = np.floor(flat * scale)
        row = np.repeat(np.arange(len(sizes)), sizes)
        good = np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) == 0
        start = np.cumsum(sizes) - sizes
        ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
        out = []
        for dim in np.unique(sizes[good]):
            rows = np.flatnonzero(good & (sizes == dim))
            vectors = flat[start[rows, None] + np.arange(dim)]
            for at in range(0, len(rows), PACK):
                part, x = rows[at : at + PACK], vectors[at : at + PACK]
                small = not x.size or np.abs(x).max() < 1 << 15
                out.append((int(dim), len(part), ids[part].tobytes(), hashes[part].tobytes(), x.astype(np.int16 if small else np.float64).tobytes()))
        if out:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["dim", "n", "ids", "hashes", "vectors"])


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = np.float64 if len(data) == 8 * n * dim else np.int16
    return np.frombuffer(data, dtype=kind).reshape(n, dim).astype(np.float64)


def segment_features(x: np.ndarray, length: int) -> np.ndarray:
    """Means times the root of their number, and deviations, of the segments of each
    row: the product of two rows' features bounds the product of the rows."""
    parts = []
    for at in range(0, x.shape[1], length):
        piece = x[:, at : at + length]
        mean = piece.mean(axis=1)
        parts += [mean * np.sqrt(piece.shape[1]), np.sqrt(((piece - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(parts, axis=1) if parts else np.zeros((len(x), 0))


# ---------------------------------------------------------------- a cell of the grid


class Tile:
    """The queries of a cell with the best candidates seen so far."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.hashes, self.x, self.k = ids, hashes, x, k
        self.lengths = [n for n in SEGMENTS if n < x.shape[1]] or [max(1, x.shape[1])]
        self.most = float(np.abs(x).max(initial=0))
        # bounds of components as large as this could overflow: such a tile does without
        self.bounded = self.most < HUGE
        self.features = [segment_features(x, n) for n in self.lengths] if self.bounded else []
        self.norm = np.sqrt((x**2).sum(axis=1)) if self.bounded else np.zeros(len(x))
        self.scores = np.full((len(ids), k), _LEAST, dtype=np.int64)
        self.found = np.full((len(ids), k), _MOST, dtype=np.int64)
        self.held = np.zeros(len(ids), dtype=np.int64)

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact scores of pairs of rows; all partial sums are integers below 2**53,
        else Python's integers are used, and results beyond a long become its ends."""
        if self._narrow(x):
            return (q * x).sum(axis=1).astype(np.int64)
        exact = (sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True))
        return np.fromiter((min(max(s, _LEAST), _MOST) for s in exact), dtype=np.int64, count=len(q))

    def _narrow(self, x: np.ndarray) -> bool:
        return x.shape[1] * min(self.most, HUGE) * min(float(np.abs(x).max(initial=0)), HUGE) < 2.0**53

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Compare all queries with candidates ``x``."""
        bounded, narrow = self.bounded and np.abs(x).max(initial=0) < HUGE, self._narrow(x)
        features = [segment_features(x, n) for n in self.lengths] if bounded else []
        norm = np.sqrt((x**2).sum(axis=1)) if bounded else np.zeros(len(x))
        for at in range(0, len(self.ids), QUERY_CHUNK):
            part = slice(at, at + QUERY_CHUNK)
            full = self.held[part] == self.k
            least = np.where(full, self.scores[part, -1].astype(np.float64), -np.inf)
            # rounding of the bounds is far below this
            least = least[:, None] - (1e-12 * self.norm[part, None] * norm + 1e-6)
            open_ = self.ids[part, None] != ids
            i = j = None
            for level, mine in zip(features, self.features, strict=False):
                if i is None:
                    open_ &= np.maximum(mine[part] @ level.T, float(_LEAST)) >= least
                    if open_.mean() <= DENSE:
                        i, j = np.nonzero(open_)
                elif len(i):
                    bound = np.einsum("ij,ij->i", mine[part][i], level[j])
                    keep = np.maximum(bound, float(_LEAST)) >= least[i, j]
                    i, j = i[keep], j[keep]
            if i is None and narrow:
                exact = np.where(open_, self.x[part] @ x.T, -np.inf)
                worst = np.where(full, self.scores[part, -1].astype(np.float64), -np.inf)
                if exact.shape[1] > self.k:  # the k-th best of this chunk is a limit as well
                    worst = np.maximum(worst, np.partition(exact, -self.k, axis=1)[:, -self.k])
                i, j = np.nonzero(open_ & (exact >= worst[:, None]))
                scores = exact[i, j].astype(np.int64)
            else:
                if i is None:
                    i, j = np.nonzero(open_)
                scores = self.products(self.x[part][i], x[j])
            self._merge(at + i, scores, ids[j])

    def _merge(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        last = self.scores[q, -1]
        better = (self.held[q] < self.k) | (scores > last) | ((scores == last) & (ids < self.found[q, -1]))
        q, scores, ids = q[better], scores[better], ids[better]
        if not len(q):
            return
        touched = np.unique(q)
        slot = np.arange(self.k)
        old = np.nonzero(slot < self.held[touched, None])
        rows = touched[old[0]]
        q, scores, ids = (np.concatenate(p) for p in ((rows, q), (self.scores[rows, old[1]], scores), (self.found[rows, old[1]], ids)))
        order = np.lexsort((ids, ~scores, q))  # ~ turns the order of longs about without overflow
        q, scores, ids = q[order], scores[order], ids[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        self.scores[q[keep], rank[keep]] = scores[keep]
        self.found[q[keep], rank[keep]] = ids[keep]
        np.maximum.at(self.held, q[keep], rank[keep] + 1)

    def results(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 4096):
            i, j = np.nonzero(np.arange(self.k) < self.held[at : at + 4096, None])
            i += at
            columns = (self.ids[i], self.hashes[i], self.found[i, j], self.scores[i, j])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_hash", "vec_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, queries first, candidates by their smallest id."""
    cell, asked, tile, waiting, held = None, [], None, [], 0

    def close():
        nonlocal waiting, held
        if tile is not None and waiting:
            tile.offer(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
        waiting, held = [], 0

    for batch in batches:
        # a pack at a time: a batch's bytes are there once already
        for r in range(batch.num_rows):
            dim, n, ids, hashes, vectors, row, t, kind = (batch.column(c)[r].as_py() for c in ("dim", "n", "ids", "hashes", "vectors", "s", "t", "kind"))
            if (dim, row, t) != cell:
                close()
                if tile is not None:
                    yield from tile.results()
                cell, asked, tile = (dim, row, t), [], None
            pack = (np.frombuffer(ids, dtype=np.int64), _matrix(vectors, n, dim), np.frombuffer(hashes, dtype=np.int64))
            if kind == 0:
                asked.append(pack)
                continue
            if not asked:
                continue
            if tile is None:
                tile = Tile(*(np.concatenate([a[i] for a in asked]) for i in (0, 2, 1)), k)
            waiting.append(pack)
            held += n
            if held >= ROW_CHUNK:
                close()
    close()
    if tile is not None:
        yield from tile.results()


# ---------------------------------------------------------------- the search


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query the ``k`` candidates of the highest integer inner product:
    query_id, rank (from 1), vec_id, score. Components become floor(scale * x);
    ties go to the smaller id; a candidate with the query's own id is left out.

    Vectors that are null or hold a null or non-finite component, and rows without
    an id, take no part. Only vectors of one length are compared. Equal query rows
    are one query; queries of one id with different vectors are answered each for
    itself. Repeated candidate rows are candidates each. Scores beyond a long
    become its ends before they are ranked. Other columns are not read. Without queries or candidates
    the result is empty.

    Quadratic by its nature, as every query meets every row: each candidate is sent
    once per ``TILE_QUERIES`` queries, each query once per ``TILE_ROWS`` candidates.
    A task's memory is one tile of queries, one chunk of candidates, and their
    products.
    """
    spark = rows.sparkSession
    plain = lambda t: t.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    pack = lambda t: t.withColumn("h", F.xxhash64("x")).mapInArrow(partial(_packed, scale=scale), _PACKS)
    asked = pack(plain(queries).distinct()).withColumn("kind", F.lit(0))
    packs = materialize(pack(plain(rows)).withColumn("kind", F.lit(1)).unionByName(asked), "vectors")
    count = {r.kind: r.n for r in packs.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    t = -(-count.get(0, 0) // TILE_QUERIES) or 1
    s = max(-(-count.get(1, 0) // TILE_ROWS), -(-3 * spark.sparkContext.defaultParallelism // t))
    number = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = packs.where("kind = 1").withColumn("s", number(s)).withColumn("t", every(t)).unionByName(packs.where("kind = 0").withColumn("t", number(t)).withColumn("s", every(s)))
    least = F.reverse(F.substring("ids", 1, 8))  # little-endian: the pack's first id
    grid = grid.repartition(s * t, "s", "t").sortWithinPartitions("dim", "s", "t", "kind", least)
    found = grid.mapInArrow(partial(_search, k=k), "query_id long, query_hash long, vec_id long, score long")
    by = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    best = materialize(best.select("query_id", "rank", "vec_id", "score"), "top-k")
    release(packs)
    return best

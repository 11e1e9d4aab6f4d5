"""Token-ID files: bit-plane shuffled, compressed id blocks with an index.

Layout of a file (little endian):

    8 bytes   magic
    per block of BLOCK ids (the last is shorter): its planes, each a zstandard frame
    footer    zstandard frame of an .npz-like run of arrays, see ``_footer``
    16 bytes  footer length (uint64), magic

A block of n ids is an n x (8 * width) matrix of bits. Byte planes store byte j
of all ids together, bit planes bit j of all ids; a plane of equal values costs
a few bytes. The chunk index in the footer gives every block's offset, id count
and plane lengths, so any id range is read without its predecessors.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import give_back, in_slices, materialize, scratch
from spanframe.llm.word_ids import tokenizer as _tokenizer
from spanframe.llm.word_ids import word_ids

MAGIC = b"SFPLANE1"
BLOCK = 1 << 16
END_ID = 1
#: Rows of a file at most about this many, while there are under MAX_FILES files.
ROWS_PER_FILE = 2000
MAX_FILES = 10_000


# ---------------------------------------------------------------- blocks


def pack_block(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of one block of unsigned ids, each compressed."""
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    planes = np.packbits(np.unpackbits(raw, axis=1).T, axis=1) if bits else raw.T
    squeeze = zstandard.ZstdCompressor(level=3)
    return [squeeze.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def unpack_block(planes: list[bytes], n: int, dtype: str, bits: bool = False) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(expand.decompress(p), dtype=np.uint8) for p in planes]
    raw = np.packbits(np.array([np.unpackbits(r)[:n] for r in rows]).T, axis=1) if bits else np.array(rows).T
    return np.ascontiguousarray(raw).view(dtype).reshape(-1) if n else np.zeros(0, dtype)


# ---------------------------------------------------------------- files


class Writer:
    """Appends documents to one file; holds at most a block and the index."""

    def __init__(self, path: str, dtype: str, bits: bool):
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.out.write(MAGIC)
        self.dtype, self.bits, self.at = dtype, bits, len(MAGIC)
        self.held, self.n_held, self.blocks, self.docs = [], 0, [], []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            every = np.concatenate(self.held)
            whole = len(every) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(every[i : i + BLOCK])
            self.held, self.n_held = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = pack_block(ids, self.bits)
        self.blocks.append((self.at, len(ids), *map(len, planes)))
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        arrays = {"dtype": np.array(self.dtype), "bits": np.array(self.bits), "blocks": np.array(self.blocks, dtype=np.int64), "docs": np.array(self.docs, dtype=np.int64).reshape(-1, 3)}
        np.savez(buffer := io.BytesIO(), **arrays)
        footer = zstandard.ZstdCompressor().compress(buffer.getvalue())
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


def open_file(path: str):
    """The open file and its footer's arrays."""
    fs, p = pafs.FileSystem.from_uri(path)
    f = fs.open_input_file(p)
    size = f.size()
    tail = f.read_at(16, size - 16)
    if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
        raise ValueError(f"{path} is not a token file")
    n = int.from_bytes(tail[:8], "little")
    return f, np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(f.read_at(n, size - 16 - n))))


def read_documents(path: str):
    """Yield (doc_id or None, start in the file, ids) in file order, a block at a time."""
    f, index = open_file(path)
    dtype, bits = str(index["dtype"]), bool(index["bits"])
    blocks, docs = iter(index["blocks"]), index["docs"]
    ready, start = np.zeros(0, dtype), 0
    with f:
        for has_id, doc_id, n in docs.tolist():
            parts = [ready]
            have = len(ready)
            while have < n:
                at, count, *lengths = (int(x) for x in next(blocks))
                raw, cuts = f.read_at(sum(lengths), at), np.cumsum([0, *lengths])
                parts.append(unpack_block([raw[a:b] for a, b in zip(cuts, cuts[1:])], count, dtype, bits))
                have += count
            joined = np.concatenate(parts) if len(parts) > 1 else ready
            yield (doc_id if has_id else None), start, joined[:n]
            ready, start = joined[n:], start + n


# ---------------------------------------------------------------- documents


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, bits: bool = False, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files under ``path`` in
    ascending doc_id order. Returns the manifest (materialized): part, file,
    n_docs, n_ids, start (ids in the files before).

    Files cut the range of doc_id at approximate quantiles, so each is written
    by one task with a block of ids in memory. A retried task writes a file of
    another name; only files that the manifest names count.

    Nulls: a null text is an empty one (just the end id); null doc_ids come
    first. Repeated doc_ids lie next to each other, shorter first. An empty
    table gives an empty manifest and no files. Other columns are not stored.
    """
    spark = docs.sparkSession
    n = docs.count()
    files = max(1, min(MAX_FILES, -(-n // rows_per_file)))
    cuts = np.unique(np.array(docs.approxQuantile("doc_id", [i / files for i in range(1, files)], 0.1 / files) if files > 1 else [], dtype=np.float64))

    def encode(batches):
        memo = word_ids(tokenizer)
        end = np.array([END_ID], dtype=memo.dtype).tobytes()
        width = np.dtype(memo.dtype).itemsize
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1)))
            for run in in_slices(rows, lambda r: len(r[1].as_py() or b""), 1 << 22):
                ids = [x.tobytes() + end for x in memo.of([t.as_py() or b"" for _, t in run])]
                keys = [d for d, _ in run]
                part = [0 if d is None else int(np.searchsorted(cuts, d, side="right")) for d in keys]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["part", "doc_id", "n", "ids"])
        give_back()

    def write(batches):
        dtype = _tokenizer(tokenizer)[1]
        part, out, name, rows = None, None, None, []

        def done():
            if out is not None:
                out.close()
                rows.append((part, name, len(out.docs), sum(d[2] for d in out.docs)))

        for batch in batches:
            for p, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if p != part:
                    done()
                    part, name = p, f"{path}/part-{p:05d}-{uuid.uuid4().hex}.ids"
                    out = Writer(name, dtype, bits)
                out.add(doc_id, np.frombuffer(ids.as_py(), dtype=dtype))
        done()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "file", "n_docs", "n_ids"])

    encoded = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(encode, "part int, doc_id long, n long, ids binary")
    dealt = encoded.repartition(files, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n", "ids")
    manifest = materialize(dealt.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "manifest")
    # at most MAX_FILES rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.createDataFrame(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).collect(), "part int, file string, n_docs long, n_ids long, start long")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files in ``manifest``: doc_id, start, n_tokens,
    ids_crc32 (of the ids as little-endian uint32) and, if asked for, ids."""

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                docs = ((d, base + s, ids.astype("<u4")) for d, s, ids in read_documents(file))
                for run in in_slices(docs, lambda r: r[2].nbytes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in run], pa.int64()), pa.array([r[1] for r in run], pa.int64()), pa.array([len(r[2]) for r in run], pa.int64()), pa.array([zlib.crc32(r[2].tobytes()) for r in run], pa.int64())]
                        + [pa.array([r[2].astype(np.int64) for r in run], pa.list_(pa.int64()))] * with_ids,
                        ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids,
                    )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    spread = manifest.select("file", "start").repartition(max(1, min(MAX_FILES, manifest.count())))
    return spread.mapInArrow(read, schema)


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str, *, bits: bool = False) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, scratch(spark, "tokens"), tokenizer, bits=bits))

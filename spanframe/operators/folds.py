"""Folds over the ordered rows of a key, for rules whose state no window can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold(df: DataFrame, step: Callable[[object, dict], tuple[object, tuple]], returns: str, *keys: str, order: list[str]) -> DataFrame:
    """Carry a state over the rows of each key: ``step(state, row)`` gives the next
    state and the values of the columns ``returns`` (DDL), added to the row. The
    state is None at a key's first row.

    A key's rows are sorted in one partition and streamed in batches, so that memory
    holds one batch and one state, however many rows a key has. Null keys are a key
    of their own. ``order`` must tell a key's rows apart, else ties fall as they come.
    """
    new = StructType.fromDDL(returns)
    types = [to_arrow_type(f.dataType) for f in new]
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                here = tuple(row[k] for k in keys)
                if here != key:
                    key, state = here, None
                state, values = step(state, row)
                out.append(values)
            added = [pa.array([v[i] for v in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, *new.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, StructType([*df.schema, *new]))


def fold_arrays(df: DataFrame, step: Callable[[object, dict[str, np.ndarray]], tuple[object, list]], reads: list[str], returns: str, *keys: str, order: list[str]) -> DataFrame:
    """Like ``fold``, but a stretch of a key's rows at once: ``step(state, columns)``
    gets numpy arrays of the columns ``reads`` only and gives the next state and one
    sequence for each column of ``returns``. A key's rows may come in several stretches,
    with the state carried between them. Null numbers come as NaN."""
    new = StructType.fromDDL(returns)
    types = [to_arrow_type(f.dataType) for f in new]
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                changed[1:] |= codes[1:] != codes[:-1]
            cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in reads}
            parts: list[list] = [[] for _ in types]
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = tuple(batch.column(k)[a].as_py() for k in keys)
                if here != key:
                    key, state = here, None
                state, out = step(state, {c: v[a:b] for c, v in columns.items()})
                for part, values, kind in zip(parts, out, types, strict=True):
                    part.append(pa.array(values, kind))
            added = [pa.concat_arrays(part) for part in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, *new.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, StructType([*df.schema, *new]))

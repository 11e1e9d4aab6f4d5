"""Changes to stored tables, as the table that results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def upsert(current: DataFrame, incoming: DataFrame, *keys: str, update: bool = True) -> DataFrame:
    """``current`` with the rows of ``incoming``, which has one row a key: where a key
    is known, the incoming row replaces it (``update``) or is left out. Null keys
    are equal to none. One shuffle of each side by the keys; to store the result,
    write it beside the old table and then swap them.
    """
    incoming = incoming.select(current.columns)
    if update:
        return current.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)
    return current.unionByName(incoming.join(current.select(*keys), list(keys), "left_anti"))

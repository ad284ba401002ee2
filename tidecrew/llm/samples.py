"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_of(rows: DataFrame, size: int, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """At most ``size`` rows with a non-NULL key: those whose hashed key is smallest, whatever the partitioning."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    return rows.filter(F.col(key).isNotNull()).orderBy(order, key).limit(size)


def labelled(docs: DataFrame, labels: DataFrame, label: str, size: int, allowed: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, text, label) of at most ``size`` labelled documents whose label row is ``allowed``.

    An id labelled twice counts once, with the higher label; NULL labels are left out.  The chosen ids are at most
    ``size``, so they are broadcast.
    """
    one = labels.filter(allowed & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    chosen = F.broadcast(sample_of(one, size, id_col))
    return docs.select(id_col, "text").join(chosen, id_col)

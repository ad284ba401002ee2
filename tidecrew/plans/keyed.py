"""Change batches: rules, winners among equal requests, and new table versions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.plans.durable import cut
from tidecrew.plans.running import running_totals

# Different first keys of a batch up to which they are sent to every task.
FEW = 1 << 16


class Change(NamedTuple):
    """A judged batch (``reason`` is NULL for accepted requests) and the table versions it leads to."""

    verdicts: DataFrame
    tables: dict[str, DataFrame]

    @property
    def accepted(self) -> DataFrame:
        return self.verdicts.filter(F.col("reason").isNull()).drop("reason")

    @property
    def rejected(self) -> DataFrame:
        return self.verdicts.filter(F.col("reason").isNotNull())


def first_failure(*rules: tuple[Column, Column | str]) -> Column:
    """The reason of the first rule whose condition holds; NULL if none does.  A NULL condition does not hold."""
    return F.coalesce(*[F.when(bad, reason if isinstance(reason, Column) else F.lit(reason)) for bad, reason in rules])


def with_winner(requests: DataFrame, keys: Sequence[str], eligible: Column, order: str = "request_id") -> DataFrame:
    """Add ``winner``: the lowest eligible request of those with the same keys.

    The minimum is pre-aggregated and joined back, so equal requests, however many, are not gathered in one task.
    """
    first = (
        requests.filter(eligible)
        .groupBy(*[F.col(k).alias(f"_w_{k}") for k in keys])
        .agg(F.min(order).alias("winner"))
    )
    same = [F.col(k) == F.col(f"_w_{k}") for k in keys]
    return requests.join(first, same, "left").drop(*[f"_w_{k}" for k in keys])


def flag_existing(requests: DataFrame, current: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add a boolean: a row with the same keys exists already.

    The current table is first cut down to the keys of the batch, which is far smaller as a rule: if it is small enough
    to be broadcast, the table is only scanned.
    """
    asked = requests.select(*keys).distinct()
    rows = current.select(*keys)
    if len(keys) > 1:
        # Rows of other first keys go before anything is shuffled, grouped or sorted, if the batch names few of them.
        first = requests.select(keys[0]).na.drop().distinct()
        few = cut(first.limit(FEW + 1))
        if few.count() <= FEW:
            rows = rows.join(F.broadcast(few), keys[0], "left_semi")
    present = rows.join(asked, list(keys), "left_semi").distinct()
    known = present.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.lit(True).alias(name))
    same = [F.col(k) == F.col(f"_e_{k}") for k in keys]
    return (
        requests.join(known, same, "left")
        .withColumn(name, F.coalesce(name, F.lit(False)))
        .drop(*[f"_e_{k}" for k in keys])
    )


def with_standing(requests: DataFrame, current: DataFrame, keys: Sequence[str], eligible: Column, name: str) -> DataFrame:
    """:func:`flag_existing` and :func:`with_winner` in one aggregate by the keys.

    A request whose keys exist already never wins, so ``eligible`` need not say so.
    """
    asked = requests.select(*keys).distinct()
    present = current.select(*keys).join(asked, list(keys), "left_semi")
    entries = requests.select(*keys, F.when(eligible, F.col("request_id")).alias("_r"), F.lit(False).alias("_e")).unionByName(
        present.select(*keys, F.lit(None).cast(requests.schema["request_id"].dataType).alias("_r"), F.lit(True).alias("_e"))
    )
    found = entries.groupBy(*[F.col(k).alias(f"_s_{k}") for k in keys]).agg(F.min("_r").alias("winner"), F.max("_e").alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    return requests.join(found, same).drop(*[f"_s_{k}" for k in keys])


def last_request(requests: DataFrame, keys: Sequence[str], order: str = "request_id") -> DataFrame:
    """The request with the highest order per key, as the later of two updates stays.

    Requests without the column ``order`` are ordered by their values, so the outcome does not depend on chance.
    """
    rest = [c for c in requests.columns if c not in keys and c != order]
    values = [order, *rest] if order in requests.columns else rest
    if not values:
        return requests.distinct()
    return (
        requests.groupBy(*keys)
        .agg(F.max(F.struct(*values)).alias("last"))
        .select(*keys, *[F.col(f"last.{c}").alias(c) for c in values])
    )


def keyed_update(current: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``current`` with ``columns`` replaced where ``batch`` has the key; of several requests for a key the last counts."""
    order = ["request_id"] if "request_id" in batch.columns else []
    new = last_request(batch.select(*order, *keys, *columns), keys).select(
        *[F.col(k).alias(f"_u_{k}") for k in keys],
        *[F.col(c).alias(f"_n_{c}") for c in columns],
        F.lit(True).alias("_hit"),
    )
    same = [F.col(k) == F.col(f"_u_{k}") for k in keys]
    changed = {
        c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)).cast(current.schema[c].dataType) for c in columns
    }
    return current.join(new, same, "left").select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in current.columns]
    )


def upsert_by_key(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides; where both have a key the batch's row stays, the last request's if there are several."""
    batch = last_request(batch, keys)
    kept = current.join(batch.select(*keys), list(keys), "left_anti")
    typed = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in current.schema.fields])
    return kept.unionByName(typed)


def numbered_after(rows: DataFrame, order: str, current: DataFrame, name: str = "id") -> DataFrame:
    """Add ids that go on after the highest id of ``current``, in the given order."""
    highest = F.coalesce(current.agg(F.max("id")).scalar(), F.lit(0))
    numbered = running_totals(rows, [], order, {"_nth": F.lit(1)}, levels=3)
    return numbered.withColumn(name, highest + F.col("_nth")).drop("_nth")

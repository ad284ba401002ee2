"""Structured Streaming forms of the live figures, sign-ups and stock.

Every job reads the event files as a stream, works through what is there (``availableNow``) and keeps results, state
and progress below one folder of the shared storage.  Given the same folder ``out``, a later run goes on where the last
one stopped; without one a run starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tidecrew.operators.changes import REFUSED
from tidecrew.plans.durable import cut, new_folder
from tidecrew.sources.catalog import Tables

# Lateness allowed for the daily donations (fixed value), and files that one batch takes at most.
LATENESS = "1 hour"
FILES_PER_BATCH = 1000


def event_stream(spark: SparkSession, folder: str, file_name: str = "events.parquet", files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The event files as a stream, with a time-zone aware timestamp that watermarks accept."""
    schema = spark.read.parquet(f"{folder}/{file_name}").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    events = source.option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(writer: DataStreamWriter, folder: str) -> None:
    query = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def _each_batch(stream: DataFrame, mode: str, handle: Callable[[DataFrame, int], None], folder: str) -> None:
    _run(stream.writeStream.outputMode(mode).foreachBatch(handle), folder)


def live_totals(events: DataFrame) -> DataFrame:
    """Running count and amount per kind of event; the state is one row per kind."""
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(10,2)")).alias("amount")
    )


def live_impact(spark: SparkSession, folder: str, out: str | None = None) -> DataFrame:
    """Totals after everything that has arrived; each batch replaces the last figures."""
    out = out or new_folder(spark, "live_impact")

    def replace(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{out}/totals")

    _each_batch(live_totals(event_stream(spark, folder)), "complete", replace, out)
    return spark.read.parquet(f"{out}/totals")


def daily_donations(events: DataFrame) -> DataFrame:
    """Donations per day, final once the watermark has passed the end of the day."""
    return (
        events.filter(F.col("event_type") == "purchase")
        .withWatermark("ts", LATENESS)
        .groupBy(F.window("ts", "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("donations"), F.sum(F.col("value").cast("decimal(10,2)")).alias("amount"))
        .select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "donations", "amount")
    )


def donations_by_day(spark: SparkSession, folder: str, out: str | None = None) -> DataFrame:
    """Closed days only: the last day stays open until later events arrive."""
    out = out or new_folder(spark, "donations_by_day")
    writer = daily_donations(event_stream(spark, folder)).writeStream.outputMode("append")
    _run(writer.format("parquet").option("path", f"{out}/days"), out)
    return spark.read.parquet(f"{out}/days")


def corrected_donations(spark: SparkSession, folder: str, out: str | None = None) -> DataFrame:
    """As :func:`donations_by_day`, but rows that come after their day was closed are added to it.

    Every batch writes its sums by day below a folder of its own, rows of closed days apart from the others, so a repeated batch
    replaces its rows.  The folder of a batch also holds how far time had come, so a batch reads that of the one before only.
    """
    out = out or new_folder(spark, "corrected_donations")
    seen_by = f"{out}/seen"

    def add(arrived: DataFrame, batch: int) -> None:
        session = arrived.sparkSession
        bought = arrived.filter(F.col("event_type") == "purchase")
        before = session.read.schema("newest timestamp").parquet(f"{seen_by}/batch={batch - 1}") if batch else None
        newest = before.first()["newest"] if before is not None else None
        closed = F.lit(newest).cast("timestamp") - F.expr(f"interval {LATENESS}")
        day = F.window("ts", "1 day")
        sums = bought.groupBy(day.alias("day")).agg(
            F.count(F.lit(1)).alias("donations"), F.sum(F.col("value").cast("decimal(10,2)")).alias("amount"), F.max("ts").alias("newest")
        )
        late = F.coalesce(F.col("day.end") <= closed, F.lit(False))
        parts = cut(sums.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), F.col("day.end").alias("ends"), "donations", "amount", late.alias("late"), "newest"))
        parts.drop("newest").write.mode("overwrite").parquet(f"{out}/parts/batch={batch}")
        so_far = parts.agg(F.greatest(F.max("newest"), F.lit(newest).cast("timestamp")).alias("newest"))
        so_far.coalesce(1).write.mode("overwrite").parquet(f"{seen_by}/batch={batch}")

    _each_batch(event_stream(spark, folder), "append", add, out)
    parts, seen = spark.read.parquet(f"{out}/parts"), spark.read.parquet(seen_by)
    closed = seen.agg(F.max("newest") - F.expr(f"interval {LATENESS}")).scalar()
    return (
        parts.filter(F.col("ends") <= closed)
        .groupBy("day")
        .agg(
            F.sum("donations").alias("donations"),
            F.sum("amount").cast("decimal(20,2)").alias("amount"),
            F.sum(F.when(F.col("late"), F.col("donations")).otherwise(0)).alias("late_donations"),
        )
    )


def first_of_kind(events: DataFrame) -> DataFrame:
    """The first event of every user and kind.  Repeats are dropped for ever: the state has a row per pair, on disk."""
    return events.dropDuplicates(["user_id", "event_type"])


def first_join(spark: SparkSession, folder: str, out: str | None = None) -> DataFrame:
    """Users and kinds of events they took part in, each once."""
    out = out or new_folder(spark, "first_join")
    writer = first_of_kind(event_stream(spark, folder)).select("user_id", "event_type").writeStream
    _run(writer.outputMode("append").format("parquet").option("path", f"{out}/joins"), out)
    return spark.read.parquet(f"{out}/joins")


class Withdrawals(StatefulProcessor):
    """What is left of every product: the state holds one number per product that was asked for and has a stock.

    A row brings the ``stock`` its product had at the start, which counts until the product has a state of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "quantity long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        # The requests of one product in one batch, which the files of a batch bound.
        asked = pd.concat(list(rows)).sort_values("request_id", kind="stable")
        stock = self.left.get()[0] if self.left.exists() else asked["stock"].iloc[0]
        known = not pd.isna(stock)
        left = int(stock) if known else 0
        reasons = []
        for quantity in asked["quantity"].tolist():
            fits = known and not pd.isna(quantity) and quantity <= left
            left -= int(quantity) if fits else 0
            reasons.append(None if fits else REFUSED)
        if known:
            self.left.update((left,))
        yield asked.drop(columns="stock").assign(reason=pd.Series(reasons, index=asked.index, dtype=object))

    def close(self) -> None:
        pass


def current_stock(spark: SparkSession, out: str) -> DataFrame:
    """(id, quantity): what the ledger has left of every product with a known stock.

    Read from its state; a product that nobody has asked for has what it had at the start.
    """
    state = spark.read.format("statestore").option("stateVarName", "left").load(f"{out}/progress")
    left = state.select(F.col("key.product_id").alias("id"), F.col("value.quantity").alias("quantity"))
    first = spark.read.parquet(f"{out}/first_stock").filter("quantity is not null")
    touched = left.select(F.col("id").alias("_touched"))
    rest = first.join(touched, F.col("product_id").eqNullSafe(F.col("_touched")), "left_anti")
    return left.unionByName(rest.select(F.col("product_id").alias("id"), "quantity"))


def stock_ledger(requests: DataFrame, t: Tables, out: str | None = None) -> DataFrame:
    """Stock withdrawals (request_id, product_id, quantity) as they arrive: the verdicts of all batches.

    Batch by batch, the requests of a product are served in the order of their ids; one that exceeds what is left is turned down.  What
    is left is kept as state by product, so a batch costs what its own requests cost, however many came before, and a look at the
    stock of the first run's products, which counts for a product until it is asked for.
    """
    spark = t.spark
    out = out or new_folder(spark, "stock_ledger")
    # The first run's stock: later runs go on from the state.
    stock = t.products.groupBy(F.col("id").alias("product_id")).agg(F.first("quantity").alias("quantity"))
    stock.write.mode("ignore").parquet(f"{out}/first_stock")
    first = spark.read.parquet(f"{out}/first_stock").select(F.col("product_id").alias("_stocked"), F.col("quantity").alias("stock"))
    stocked = requests.join(first, F.col("product_id").eqNullSafe(F.col("_stocked")), "left").drop("_stocked")
    schema = T.StructType([*requests.schema.fields, T.StructField("reason", T.StringType())])
    verdicts = stocked.groupBy("product_id").transformWithStateInPandas(
        Withdrawals(), outputStructType=schema, outputMode="append", timeMode="none"
    )
    _run(verdicts.writeStream.outputMode("append").format("parquet").option("path", f"{out}/verdicts"), out)
    return spark.read.schema(schema).parquet(f"{out}/verdicts")
